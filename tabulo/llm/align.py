"""Cross-tokenizer alignment (operator 13): pointer jumping over overlapping tokens.

Two tokenizers cut the same bytes (a space and the text) into tokens A and B.  Every token points to the
token of the other side that reaches farthest to the right among those that overlap it, which is the one that
holds its last byte; where both end at the same byte the token of B is terminal and points to itself.
Doubling the successors (``to = to[to]``) until nothing changes brings every token to the terminal token of
its component, whose number labels the group; the rounds are logarithmic in the longest chain.  All texts of
a batch are laid end to end, so one vectorised pass serves them all.

A link is a pair of tokens, one of A and one of B, that end at the same byte.  Counts of id pairs are taken
over the whole corpus.  The most frequent pairs (at most FREQUENT, the bound of what is broadcast) rate the
links where they are; links of the other pairs, none of which is frequent, meet their counts in a shuffle join.

Edge cases: null and empty texts have no tokens, and neither have texts whose tokens do not give their bytes back
(normalised or unknown characters): zeros and an empty group string.  Repeated rows each count; every row of
the input is one row of the output; names of special tokens in a text are plain text.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: id pairs that are broadcast
FREQUENT = 1 << 20
#: bytes of text that are laid end to end
BLOCK = 1 << 18
#: fixed value: the pattern that byte-level tokenizer files split texts by
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: characters below this one are letters, digits or blanks alike in every Unicode version
SETTLED = "ɐ"
MAX_FILE = 64 << 20


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself and the others as letters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library.  Where ids follow the order of the merges and all characters of a
    text are SETTLED ones, the same ids come faster by ranks."""

    def __init__(self, blob: bytes):
        self.blob = blob
        letters, model = byte_letters(), json.loads(blob)
        vocabulary = model["model"]["vocab"]
        special = {t["content"] for t in model["added_tokens"]}
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.pieces[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        in_order = all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(ranks) == 256 + len(merges)
        split = model["pre_tokenizer"]
        plain = (split["type"], split.get("use_regex", True), split["add_prefix_space"], model["normalizer"]) == ("ByteLevel", True, False, None)
        self.fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}) if in_order and plain else None

    @functools.cached_property
    def slow(self) -> tokenizers.Tokenizer:
        """The library's own tokenizer, made when a text first needs it."""
        made = tokenizers.Tokenizer.from_str(self.blob.decode())
        made.encode_special_tokens = True
        return made

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text."""
        return [self.fast.encode_ordinary(" " + t) if self.fast and (t.isascii() or max(t) < SETTLED) else self.slow.encode(" " + t, add_special_tokens=False).ids for t in texts]


class Pieces:
    """A sentencepiece model, which puts a space before each text itself."""

    def __init__(self, blob: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=blob)
        named = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=2)
def _sides(one: bytes, two: bytes) -> tuple:
    """Both vocabularies, their tokens' lengths and what each token adds to a group string: with ',' or, as the last of
    its side, with '|' (A) and ';' (B; nothing at the end of a text)."""
    a, b = ByteLevel(one), Pieces(two)
    lengths = [np.array([len(x) for x in side.pieces], np.int64) for side in (a, b)]
    parts = [f"{i}{end}" for i in range(len(a.pieces)) for end in ",|"] + [f"{i}{end}" for i in range(len(b.pieces)) for end in (",", ";", "")]
    return a, b, lengths, parts


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token of A and of B the token of B that ends its group; ends ascend, the last ones are equal."""
    a, b = len(ends_a), len(ends_b)
    over = np.searchsorted(ends_b, ends_a)  # holds the last byte of a token of A
    under = np.searchsorted(ends_a, ends_b)
    to = np.concatenate([a + over, np.where(ends_a[under] == ends_b, a + np.arange(b), under)]) if b else np.empty(0, np.int64)
    while not np.array_equal(farther := to[to], to):
        to = farther
    return to[:a] - a, to[a:] - a


def _blocks(texts: list):
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= BLOCK):
            size += len(texts[end] or "")
            end += 1
        yield texts[at:end]
        at = end


def align_block(texts: list, a, b, lengths, parts, digest: bool = False):
    """(n_a, n_b, n_groups, groups, links) of each text; digest: the groups' SHA-256 instead of their string."""
    found = [(0, 0, 0, "", np.empty(0, np.int64))] * len(texts)
    asked = [i for i, t in enumerate(texts) if t]
    ids = list(zip(asked, a.encode([texts[i] for i in asked]), b.encode([texts[i] for i in asked])))
    of_a, of_b = a.pieces.__getitem__, b.pieces.__getitem__
    ids = [(i, x, y) for i, x, y in ids if (want := (" " + texts[i]).encode()) == b"".join(map(of_a, x)) and want == b"".join(map(of_b, y))]
    if not ids:
        return found
    cuts_a, cuts_b = (np.concatenate([[0], np.cumsum([len(x[k]) for x in ids])]) for k in (1, 2))
    ids_a, ids_b = (np.fromiter(itertools.chain.from_iterable(x[k] for x in ids), np.int64, cut[-1]) for k, cut in ((1, cuts_a), (2, cuts_b)))
    ends_a, ends_b = np.cumsum(lengths[0][ids_a]), np.cumsum(lengths[1][ids_b])
    to_a, to_b = terminals(ends_a, ends_b)

    last_b = to_b == np.arange(len(to_b))
    number = np.cumsum(last_b) - 1  # of the group that a terminal token ends
    group_a, group_b, n_groups = number[to_a], number[to_b], int(last_b.sum())
    last_a = np.append(group_a[1:] != group_a[:-1], True)
    end_a, end_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    links = ids_a[end_a - 1] * len(b.pieces) + ids_b[end_b - 1]

    # the group strings: tokens of A of a group, then its tokens of B
    code = np.empty(len(ids_a) + len(ids_b), np.int64)
    code[np.arange(len(ids_a)) + np.append(0, end_b)[group_a]] = ids_a * 2 + last_a
    end = last_b.astype(np.int64)
    end[cuts_b[1:] - 1] = 2
    code[np.arange(len(ids_b)) + end_a[group_b]] = 2 * len(a.pieces) + ids_b * 3 + end
    of_part = parts.__getitem__
    groups_at = np.searchsorted(end_b, cuts_b[1:], side="right")
    before = 0
    for k, (i, x, y) in enumerate(ids):
        string = "".join(map(of_part, code[cuts_a[k] + cuts_b[k]:cuts_a[k + 1] + cuts_b[k + 1]].tolist()))
        if digest:
            string = hashlib.sha256(string.encode()).hexdigest()
        found[i] = (len(x), len(y), int(groups_at[k] - before), string, links[before:groups_at[k]])
        before = groups_at[k]
    assert before == n_groups
    return found


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        blob = f.read(MAX_FILE + 1)
    if len(blob) > MAX_FILE:
        raise ValueError(f"tokenizer file over {MAX_FILE} bytes")
    return blob


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", digest: bool = False) -> DataFrame:
    """docs with a column ``aligned``: n_a, n_b (tokens), n_groups, groups (``a1,a2|b1;a3|b2,b3``: the ids of A and of B in
    each group) and links (one number for each pair of tokens that end together, in order: id of A times
    the size of B's vocabulary plus id of B).  The group strings are several times as long as the texts: with
    ``digest`` their SHA-256 leaves the workers in their place.  path_a is a byte-level file of the tokenizers library, path_b a sentencepiece
    model; the driver reads them and sends their bytes."""
    sent = docs.sparkSession.sparkContext.broadcast((read_file(path_a), read_file(path_b)))

    @F.arrow_udf("struct<n_a:bigint,n_b:bigint,n_groups:bigint,groups:string,links:array<bigint>>")
    def aligned(texts: pa.Array) -> pa.Array:
        sides = _sides(*sent.value)
        found = [x for block in _blocks(texts.to_pylist()) for x in align_block(block, *sides, digest)]
        n_a, n_b, n_groups, groups, links = zip(*found) if found else [()] * 5
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in links])]).astype(np.int32)
        flat = np.concatenate([np.empty(0, np.int64), *links])
        arrays = [*(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
        return pa.StructArray.from_arrays(arrays, names=["n_a", "n_b", "n_groups", "groups", "links"])

    return docs.withColumn("aligned", aligned(F.col(text).cast("string")))


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """links (uid, links) -> (pair, n, best): how many links of the corpus hold the pair, and whether no pair with the same
    id of B has more."""
    counts = stored(links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    ids_b = F.pmod("pair", F.lit(size_b))
    most = counts.groupBy(ids_b.alias("b")).agg(F.max("n").alias("most"))  # at most as many rows as B has ids
    return stored(counts.withColumn("b", ids_b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def rate_links(links: DataFrame, size_b: int, frequent: int = FREQUENT) -> DataFrame:
    """links (uid unique, links) -> (uid, n_best, count_sum) of the rows that have links."""
    counts = pair_counts(links, size_b)
    sizes = counts.groupBy((F.length(F.bin("n")) - 1).alias("power")).count().collect()  # at most 63 rows
    least, room = 62, frequent
    for power, n in sorted(((r["power"], r["count"]) for r in sizes), reverse=True):
        if n > room:
            break
        least, room = power, room - n
    known = F.broadcast(counts.where(F.col("n") >= F.lit(1 << least)))  # no more than `frequent` rows
    each = links.select("uid", F.explode("links").alias("pair"))
    sums = [F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum")]
    rated = each.join(known, "pair").groupBy("uid").agg(*sums)
    if any(r["power"] < least for r in sizes):
        rare = each.join(known, "pair", "left_anti").join(counts.where(F.col("n") < F.lit(1 << least)), "pair")
        rated = rated.union(rare.groupBy("uid").agg(*sums)).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rated


def align_corpus(docs: DataFrame, path_a: str, path_b: str, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of docs: n_best links have a
    pair that is the most frequent one of its id of B in the whole corpus (ties included), count_sum adds up the pairs' counts."""
    x = align(docs.select(F.col(id_).alias("doc_id"), F.col(text).cast("string").alias("t")), path_a, path_b, "t", digest=True)
    rows = stored(x.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "aligned.n_a", "aligned.n_b", "aligned.n_groups", F.col("aligned.groups").alias("groups_sha256"), "aligned.links"))
    size_b = len(Pieces(read_file(path_b)).pieces)
    rated = rate_links(rows.where("n_a > 0").select("uid", "links"), size_b)
    done = rows.withColumn("n_links", F.size("links").cast("long")).drop("links").join(rated, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
