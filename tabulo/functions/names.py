"""Column-name rules as Column expressions over a catalog DataFrame.

A catalog is any DataFrame with a string column holding column names (for
example ``(table, column, ordinal)`` listed from many tables); every rule
here is a native expression so one query classifies the names of a whole
lake.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, strip_accents, strip_ws

# Smart-rename synonym rules (P06).  The whole cleaned name
# must match one alternative; the first matching rule wins.
RENAME_RULES = [
    ("jour", "date_jour"),
    ("mois", "date_mois"),
    ("an", "date_an"),
    ("dt|date|annee|year", "date"),
    ("hrmn|heure|heureminute|heure_minute|hr|mn|min|minute", "heure_minute"),
    ("montant|mnt|amount|total|prix|cost|revenue|valeur|value", "montant"),
    ("nb|nombre|qty|quantite|quantity", "nombre"),
    ("cat|categorie|category", "categorie"),
    ("desc|description|texte|text", "description"),
    ("id|identifiant|code|pk|fk|row", "identifiant"),
    ("lat|latitude", "latitude"),
    ("long|longitude", "longitude"),
    ("dep|departement", "departement"),
    ("com|commune|ville|city", "commune"),
    ("agg|agglomeration", "agglomeration"),
    ("atm|atmosphere", "atmosphere"),
    ("col|collision", "collision"),
    ("adr|adresse|address", "adresse"),
    ("lum|lumiere|luminosite|light|brightness", "luminosite"),
    ("vit|vitesse|speed", "vitesse"),
    ("meteo|weather|cond|condition", "meteo"),
    ("grav|gravite|severity", "gravite"),
    ("bless|blesse|injury|injured", "blesses"),
    ("mort|mortality|dead|deaths", "deces"),
    ("sexe|gender|sex|homme|femme|male|female", "sexe"),
    ("age|years_old|ans", "age"),
    ("nb_vehicles|nb_cars|vehicles|cars", "nombre_vehicules"),
]

# Abbreviation suggestions (P07), in lookup order.
SUGGESTIONS = [
    ("dep", "département"), ("com", "commune"), ("agg", "agglomération"),
    ("atm", "atmosphère"), ("col", "collision"), ("lum", "luminosité"),
    ("int", "intersection"), ("hrmn", "heure_minute"), ("an", "année"),
    ("jour", "jour"), ("mois", "mois"), ("num_acc", "num_accident"),
    ("adr", "adresse"), ("lat", "latitude"), ("long", "longitude"),
    ("id", "identifiant"), ("qty", "quantité"), ("amt", "montant"),
    ("addr", "adresse"), ("temp", "température"), ("val", "valeur"),
    ("cnt", "compte"), ("pct", "pourcentage"), ("avg", "moyenne"),
    ("max", "maximum"), ("min", "minimum"),
]

# Name keywords used by the type rules.
ID_NAME_WORDS = ["id", "identifiant", "code", "pk", "fk", "row"]
GUESS_ID_WORDS = ["id", "identifiant", "numero", "order id", "customer id", "pk", "fk", "row"]
GUESS_DATE_WORDS = ["date", "jour", "mois", "année", "annee", "year", "month", "day",
                    "created", "updated", "timestamp", "datetime"]
GUESS_NUMBER_WORDS = ["prix", "montant", "cost", "revenue", "qty", "quantite", "nombre", "sales",
                      "profit", "discount", "quantity", "amount", "total", "value"]
FORBIDDEN_EXACT = ["id", "pk", "fk", "row", "index", "jour", "mois", "an", "annee", "année"]
FORBIDDEN_CONTAINS = ["num_acc", "latitude", "longitude"]
FORBIDDEN_RE = r"(^|[_\W])(id|pk|fk)([_\W]|$)"
IDENTIFIER_EXACT = ["id", "index", "uuid"]


def contains_any(s: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | (F.instr(s, w) > 0)
    return out


def snake_case(col) -> Column:
    """P06 smart rename of one name (expression)."""
    s = strip_ws(_c(col))
    s = F.regexp_replace(s, r"([a-z0-9])([A-Z])", "$1_$2")
    s = F.lower(strip_accents(s))
    s = F.regexp_replace(s, r"[\s\-]+", "_")
    s = F.regexp_replace(s, r"[^a-z0-9_]", "")
    mapped = None
    for pattern, repl in RENAME_RULES:
        cond = s.rlike(f"^({pattern})$")
        mapped = F.when(cond, F.lit(repl)) if mapped is None else mapped.when(cond, F.lit(repl))
    s = mapped.otherwise(s)
    s = F.regexp_replace(s, r"__+", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


def suggest_name(col) -> Column:
    """Exact abbreviation, else first contained abbreviation, else
    capitalised short alphabetic name, else unchanged."""
    orig = _c(col)
    low = strip_ws(F.lower(orig))
    exact = None
    for abbr, full in SUGGESTIONS:
        cond = low == abbr
        exact = F.when(cond, F.lit(full)) if exact is None else exact.when(cond, F.lit(full))
    for abbr, full in SUGGESTIONS:
        exact = exact.when(F.instr(low, abbr) > 0, F.lit(full))
    short = (F.length(low) <= 4) & low.rlike(r"^\p{L}+$")
    return exact.when(short, F.initcap(low)).otherwise(orig)


def is_forbidden(col) -> Column:
    """P10: names never used as analysis columns."""
    low = F.lower(_c(col))
    return (
        low.isin(*FORBIDDEN_EXACT)
        | low.startswith("id_")
        | low.endswith("_id")
        | contains_any(low, FORBIDDEN_CONTAINS)
        | low.rlike(FORBIDDEN_RE)
    )


def identifier_name(col) -> Column:
    """Name part of P09."""
    low = F.lower(_c(col))
    return (
        low.isin(*IDENTIFIER_EXACT)
        | low.startswith("id_")
        | low.endswith("_id")
        | (F.instr(low, "identifiant") > 0)
        | (F.instr(low, "num_acc") > 0)
        | low.startswith("num_")
    )


def dedupe_names(df, name_col: str, order_col: str, partition_cols=(), out_col: str = "final_name"):
    """Collisions after renaming: in order, a name that is taken gets ``_2``, ``_3``..., the first suffix that no name of the
    group has or was given; names differing in case only collide, a null name stays null.  The suffix ends a name in one way
    only, so names get theirs independently of each other: the m-th repetition of a name has the m-th number from 2 on that,
    put behind it, makes no name of the group.  No group is collected; windows sort the rows of one name."""
    from pyspark.sql import Window

    keys, added = [], []
    for i, c in enumerate((*partition_cols, "stem", "row", "number")):
        name = f"_{c}{i}"
        while name.lower() in {x.lower() for x in (*df.columns, out_col)}:
            name = f"_{name}"
        (keys if i < len(partition_cols) else added).append(name)
    stem, row, number = added
    # m: which repetition of its name a row is (0: the first one, which keeps the name)
    names = df.select("*", *(F.col(c).alias(k) for c, k in zip(partition_cols, keys)), F.lower(F.col(name_col)).alias(stem))
    rows = names.withColumn(row, F.row_number().over(Window.partitionBy(*keys, stem).orderBy(order_col, name_col)) - 1)
    # the numbers of a name that other names of the group have; the i-th, b, has b - i - 1 others before it, counted from 2
    suffix = r"(?s)^(.*)_([1-9][0-9]{0,8})$"
    held = names.where(F.col(stem).rlike(suffix)).select(*keys, stem).distinct()
    held = held.select(*keys, F.regexp_extract(stem, suffix, 1).alias(stem), F.regexp_extract(stem, suffix, 2).cast("int").alias(number)).where(F.col(number) >= 2)
    others = F.col(number) - F.row_number().over(Window.partitionBy(*keys, stem).orderBy(number)) - 1
    both = rows.withColumn(number, F.lit(None).cast("int")).unionByName(held.withColumn(row, others + 1), allowMissingColumns=True)
    # those that are jumped over come first where both have the same place
    before = F.count(number).over(Window.partitionBy(*keys, stem).orderBy(F.col(row), F.col(number).isNull()).rowsBetween(Window.unboundedPreceding, 0))
    final = F.when(F.col(row) == 0, F.col(name_col)).otherwise(F.concat(F.col(name_col), F.lit("_"), (F.col(row) + 1 + before).cast("string")))
    numbered = both.withColumn(out_col, final).where(F.col(number).isNull())
    return numbered.select(*(F.col(f"`{c}`") for c in df.columns), out_col)
