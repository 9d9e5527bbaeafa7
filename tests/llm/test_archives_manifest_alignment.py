"""Operators 11 to 13 against brute force, on odd and on empty tables."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
from tabulo.llm import align, merkle, warc

from .conftest import prose

SF = "/root/testdata/sf0.001"
FILES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


# ---- 11

def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def round_trip(spark, table, tmp_path, **kw):
    folder = str(tmp_path / "archives")
    warc.write_archives(table, folder, **kw)
    return folder, warc.read_archives(spark, folder)


ODD = [(5, "http://a.example/x?y=1#z", "same"), (2, "http://b.example", "same"), (9, None, "same"), (None, "u", "same"), (3, "http://c d\r\nX: y/\t", ""), (4, "é", None),
       (7, "http://e/", "WARC/1.1\r\n\r\nWARC/1.0 WARC/1.WARC/1.\r\n\r\n"), (7, "http://e/", "WARC/1.1\r\n\r\nWARC/1.0 WARC/1.WARC/1.\r\n\r\n"), (8, "http://f/", "é漢🙂\x00\r\n\r\n"), (10, "http://g/", "x" * 200_000)]


def test_every_page_comes_back(spark, tmp_path):
    table = pages(spark, ODD)
    _, records = round_trip(spark, table, tmp_path)
    found = warc.captures(records.cache())
    assert records.where("error IS NOT NULL").count() == 0 and found.count() == len(ODD)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_captures(found).collect())
    want, first = Counter(), {}
    for i, _, h in sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (h or "").encode()
        want[i, len(data), digest(data), "revisit" if data in first else "response", first.get(data)] += 1
        first.setdefault(data, i)
    assert got == want
    # payloads are whole, and each capture has its request and metadata
    bodies = {bytes(r.response.payload) for r in found.collect() if r.response.type == "response"}
    assert bodies == {(h or "").encode() for _, _, h in ODD}
    assert all(len(r.requests) == len(r.metadata) == 1 and not r.others and r.part == 0 for r in found.collect())


def test_small_payloads_are_all_responses(spark, tmp_path):
    _, records = round_trip(spark, pages(spark, ODD + [(1, "v", "same"), (1, "v", "same")]), tmp_path, min_bytes=5)
    types = Counter(r.record_type for r in warc.page_captures(warc.captures(records)).collect())
    assert types == {"response": 11, "revisit": 1}


def test_files_are_warc(spark, tmp_path):
    folder, _ = round_trip(spark, pages(spark, [(1, "http://a/b c", "<p>x</p>")]), tmp_path)
    data = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "archives").glob("*.gz")))
    at, kinds = 0, []
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest[int(fields["Content-Length"]):][:4] == b"\r\n\r\n"
        kinds.append(fields["WARC-Type"])
        assert fields["WARC-Target-URI"] == "http://a/b%20c"
        at += len(head) + 4 + int(fields["Content-Length"]) + 4
    assert kinds == ["request", "response", "metadata"]


def foreign(*records):
    out = b""
    for version, block, *headers in records:
        out += f"WARC/{version}\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    return out


def test_transactions_of_other_archives(spark, tmp_path, monkeypatch):
    """Several files, both directions and chains of identifiers, missing captures, broken records, many records around one."""
    monkeypatch.setattr(warc, "PART", 3)
    kind = lambda t, i, *more: (("WARC-Type", t), ("WARC-Record-ID", f"<{i}>"), *more)
    to = lambda i: ("WARC-Concurrent-To", f"<{i}>")
    one = foreign(("1.0", b"software: WARC/1.0 tool\r\n", *kind("warcinfo", "w")), ("1.0", b"HTTP/1.1 200 OK\r\n\r\nbody WARC/1.1\r\n", ("Content-Type", "application/http; msgtype=response"), *kind("response", "r1", to("q1"))),
                  ("1.1", b"GET /", *kind("request", "q1")), ("1.1", b"a: b", *kind("metadata", "m1", to("q1"))), ("1.1", b"c", *kind("metadata", "m2", to("m1"))),
                  ("1.1", b"lost", *kind("request", "q2", to("nowhere"))), ("1.1", b"bad", ("WARC-Type", "response")))
    two = foreign(("1.1", b"plain", *kind("resource", "r2")), *(("1.1", b"x", *kind("metadata", f"n{i}", to("r2"))) for i in range(20)))
    folder = tmp_path / "foreign"
    folder.mkdir()
    (folder / "one.warc.gz").write_bytes(gzip.compress(one[:400]) + gzip.compress(one[400:]))
    (folder / "two.warc.gz").write_bytes(gzip.compress(two + foreign(("1.1", b"cut off here", *kind("response", "r3")))[:-12]))
    records = warc.read_archives(spark, str(folder)).cache()
    assert Counter(r.error for r in records.collect() if r.error) == {"no valid header": 1, "cut off": 1}
    found = defaultdict(list)
    for r in warc.captures(records).collect():
        found[r.record_id].append(r)
    (a,) = found["<r1>"]
    assert bytes(a.response.payload) == b"body WARC/1.1\r\n" and [x.record_id for x in a.requests] == ["<q1>"] and {x.record_id for x in a.metadata} == {"<m1>", "<m2>"}
    assert {x.record_id for r in found["<r2>"] for x in r.metadata} == {f"<n{i}>" for i in range(20)} and len(found["<r2>"]) > 3
    (lost,) = found["<nowhere>"]
    assert lost.response is None and lost.requests[0].block == "lost"


def test_archives_of_nothing(spark, tmp_path):
    _, records = round_trip(spark, pages(spark, []), tmp_path)
    assert records.count() == 0 and warc.page_captures(warc.captures(records)).count() == 0


# ---- 12

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves, arity):
    """Levels of nodes."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, i, arity):
    found = []
    for level in levels[:-1]:
        run = i // arity * arity
        found.append(("".join(level[run:i]), "".join(level[i + 1:run + arity])))
        i //= arity
    return found


def by_hand(rows, arity):
    """{(id, leaf): subroot, root, proof, folded root} of (id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for i, s, la, n, t in rows:
        head = [field(x) for x in (i, s, la, n)]
        changed = t.replace("\n", "") if t is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t
        groups[s].append((i is not None, i or 0, h(*head, field(t)), h(*head, field(changed))))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])], arity) for s in sources}
    top = tree([trees[s][-1][0] for s in sources], arity)
    out = Counter()
    for k, s in enumerate(sources):
        for at, (known, i, leaf, changed) in enumerate(sorted(groups[s])):
            steps = path(trees[s], at, arity) + path(top, k, arity)
            folded = changed
            for left, right in steps:
                folded = h(left, folded, right)
            out[i if known else None, leaf, trees[s][-1][0], top[-1][0], h(*(x + y for x, y in steps)), folded] += 1
    return out


def made(docs, arity):
    found = merkle.document_manifest(docs, arity)
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("p"), merkle.fold(F.col("changed_leaf"), F.col("path")).alias("f"))
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_by_hand(spark, arity):
    r = random.Random(arity)
    sources = [None, "", "a", "é", "Z", *(f"s{i}" for i in range(8))]
    rows = [(r.choice([None, *range(60)]), r.choice(["a", r.choice(sources)]), r.choice(["en", None]), r.choice([None, 3, -1]), r.choice([None, "", "x\ny\n", prose(i, 5)])) for i in range(300)]
    rows += [(7, "a", "en", 1, "many\nrows")] * 40 + [(1, "lone", "en", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    assert made(docs, arity) == by_hand(rows, arity)


def test_one_document_and_none(spark, nothing):
    row = (3, "a", "en", 4, "a\nb")
    docs = spark.createDataFrame([row], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert made(docs, 3) == by_hand([row], 3)
    assert merkle.document_manifest(nothing).count() == 0


def test_manifest_plan_has_no_python_or_nested_loop(spark, odd):
    plan = merkle.document_manifest(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "NestedLoop"))


# ---- 13

def aligned_by_hand(texts):
    """Rows of the contract by sets of end offsets."""
    t = Tokenizer.from_file(FILES[0])
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = align.byte_letters()
    rows, count = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a, b = t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)
        of_a = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        of_b = [bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [s.id_to_piece(i)]]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            rows.append(None)
            continue
        ends = [[], []]
        for out, tokens in zip(ends, (of_a, of_b)):
            at = 0
            for x in tokens:
                at += len(x)
                out.append(at)
        groups, x, y = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            u, v = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append((a[x:u], b[y:v]))
            x, y = u, v
        links = [(g[0][-1], g[1][-1]) for g in groups]
        count.update(links)
        rows.append((len(a), len(b), groups, links))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = row
            string = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            out.append((n_a, n_b, len(groups), len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(string.encode()).hexdigest()))
    return out


def strange_texts():
    r = random.Random(13)
    letters = "aeinrst  THE\n\t.,'0189éßñø漢字🙂‍\x00▁ẞπ"
    texts = [None, "", " ", "  two  blanks ", "a", "<|endoftext|> <s></s><unk> <0x41>", "tab\tand\nline\r\n", "▁", "ﬁ ligature", "nbsp  x", prose(1, 400)]
    return texts + ["".join(r.choices(letters, k=r.randint(1, 80))) for _ in range(120)] + [prose(i % 7, 30) for i in range(30)]


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_alignment_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(align, "BLOCK", block)
    texts = strange_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: tuple(r[c] for c in FIELDS) for r in align.align_corpus(docs, *FILES).collect()}
    want = aligned_by_hand(texts)
    assert [got[i] for i in range(len(texts))] == want and sum(w[0] > 0 for w in want) > 60


def test_rare_pairs_are_joined_to_the_same_end(spark):
    docs = spark.createDataFrame([(i, prose(i, 60)) for i in range(20)], "doc_id bigint, text string")
    x = align.align(docs, *FILES).select(F.col("doc_id").alias("uid"), "aligned.links").cache()
    want = sorted(align.rate_links(x, 32_000).collect())
    for frequent in (0, 5, 60):
        assert sorted(align.rate_links(x, 32_000, frequent).collect()) == want


def test_ranks_and_file_give_the_same_tokens():
    side = align.ByteLevel(align.read_file(FILES[0]))
    assert side.fast is not None
    letters = [chr(c) for c in range(ord(align.SETTLED))]
    r = random.Random(5)
    texts = [a + b for a in letters for b in ("", "x", " ", "1", "'s")] + ["".join(r.choices(letters, k=60)) for _ in range(3000)] + ["漢字 и π", "<|endoftext|>"]
    assert side.encode(texts) == [side.slow.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_pointer_jumping_of_long_chains():
    import numpy as np
    a, b = np.arange(2, 20_002, 2), np.append(np.arange(1, 20_000, 2), 20_000)
    to_a, to_b = align.terminals(a, b)
    assert set(to_a) == set(to_b) == {len(b) - 1}
    assert [len(x) for x in align.terminals(a[:0], b[:0])] == [0, 0]


# ---- odd and empty tables through the registered queries

def test_registered_queries(spark, tmp_path, odd, nothing):
    queries = E.queries()
    table = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, docs, html in (("odd", table, pages(spark, ODD)), ("nothing", table.limit(0), pages(spark, []))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        html.withColumn("payload", F.lit(1)).write.parquet(f"{folder}/pages.parquet")
        assert queries["op11_warc"](spark, folder).count() == html.count()
        for q in ("op12_merkle", "op13_align"):
            got = queries[q](spark, folder).collect()
            assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())


def test_registered_alignment_on_a_given_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in FIELDS) for r in E.queries()["op13_align"](spark, SF).collect()}
    assert [got[i] for i in texts] == aligned_by_hand(texts.values())
