"""Results that must not hang on partitions, ids or column names: operators 2, 4, 5, 6, 7 and the pipeline."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import lines, mixing, packing, rules, secrets, units

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else None) for i, t, s in rows], SCHEMA)


# ---- 6 -----------------------------------------------------------------------------------------
def plain_units(text: str | None, reach: int) -> list[tuple[int, int, str]]:
    """(start, end, normalised) by single steps."""
    text, fold = text or "", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words, at = [], 0
    while at < len(text):
        if text[at] in " \t\n\v\f\r":
            at += 1
            continue
        end = at
        while end < len(text) and text[end] not in " \t\n\v\f\r":
            end += 1
        words.append((at, end, text[at:end].translate(fold)))
        at = end
    n, top = len(words), (9, 0)
    value = [top] * (n + 1)
    for k in range(1, n):
        before, behind = words[k - 1][2].encode(), words[k][2].encode()
        rank = 3 if "\n" in text[words[k - 1][1] : words[k][0]] else 2 if words[k - 1][2][-1] in ".!?" else 1
        tail, head = int.from_bytes(before[-4:].rjust(4, b"\0"), "big"), int.from_bytes(behind[:4].ljust(4, b"\0"), "big")
        value[k] = (rank, (tail * units.BEFORE + head * units.BEHIND) % units.PRIME)
    places = [k for k in range(n + 1) if value[k] == top or all(value[k] > v for v in value[max(k - reach, 0) : k]) and all(value[k] >= v for v in value[k + 1 : k + 1 + reach])]
    out = []
    for a, b in zip(places, places[1:], strict=False):
        steps = [a, *(a + 2 * reach * k for k in range(1, (b - a) // (2 * reach))), b] if b - a > 4 * reach else [a, b]
        out += [(words[x][0], words[y - 1][1], " ".join(w for _, _, w in words[x:y])) for x, y in zip(steps, steps[1:], strict=False)]
    return out


def passages():
    draw = random.Random(4)
    say = lambda n: " ".join(draw.choice(["alpha", "Béta", "gamma,", "delta.", "épsilon", "zeta!"]) + str(draw.randrange(50)) for _ in range(n))
    shared, line = say(60), say(9) + "."
    rows = [(k, say(70) + " " + shared + " " + say(70), "s0") for k in range(3)]
    rows += [(10, say(30) + "\n" + line + "\n" + say(30), "s"), (11, line + "\n" + say(20), "s"), (12, "short one", "s"), (13, "Short  ONE", "s"), (14, None, "s"), (15, "", "s"), (16, " \n\t", "s")]
    rows += [(17, "same " * 300, "s"), (18, " " * 5 + " x y " * 40, "s"), (19, "z" * 200_000, "s"), (20, say(20_000), "s"), (21, "a\nb\nc. d? e\n" * 40, "s")]
    rows += [(None, shared, "s"), (None, rows[3][1], "s"), (22, say(25), "s"), (22, say(25), "s"), (0, rows[0][1], "s0"), (9, rows[5][1], "s")]
    return rows


@pytest.mark.parametrize("reach", [2, units.REACH])
def test_units_are_removed_but_for_the_earliest(spark, reach):
    rows = passages()
    place = lambda k: (rows[k][0] is None, rows[k][0] or 0, hashlib.md5((rows[k][1] or "").encode()).digest()[:7], k)
    cut = [plain_units(t, reach) for _, t, _ in rows]
    seen, gone = set(), {}
    for k in sorted(range(len(rows)), key=place):
        gone[k] = []
        for u in cut[k]:
            if u[2] in seen:
                gone[k].append((u[0], u[1]))
            seen.add(u[2])
    want = Counter((rows[k][0], len(cut[k]), tuple(gone[k])) for k in range(len(rows)))
    got = lines.repeats(frame(spark, rows).repartition(5), reach=reach).collect()
    assert Counter((r.doc_id, r.n_units, tuple((s.start, s.end) for s in r.removed)) for r in got) == want
    assert all(len(r.kept) == r.n_units - len(r.removed) for r in got)
    assert all(r.removed for r in got if r.doc_id in (1, 2, 13))


def test_units_whatever_the_slices():
    texts = pa.array([t for _, t, _ in passages()])
    whole = units.units(texts)
    parts = [units.units(b.column("t")) for b in units.by_bytes(pa.RecordBatch.from_arrays([texts], names=["t"]), "t", 100)]
    assert len(parts) > 10 and [d for p in parts for d in p[3]] == whole[3]
    assert np.concatenate([p[1] for p in parts]).tolist() == whole[1].tolist()


def test_texts_without_repeated_units(spark):
    docs = frame(spark, [(1, "one two three", "s"), (2, "ONE two  three", "s"), (3, None, "s"), (None, "one two three", "s")])
    got = {(r.doc_id, r.text) for r in lines.without(docs, lines.repeats(docs)).collect()}
    assert got == {(1, "one two three"), (2, ""), (3, None), (None, "one two three")}
    assert lines.repeats(docs.limit(0)).collect() == []


# ---- 4 -----------------------------------------------------------------------------------------
def test_quality_verdicts_whatever_the_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.union(docs.where("doc_id < 40").withColumn("text", F.concat(F.lit("! "), "text")))
    one, other = (Counter((r.doc_id, r.n_words, round(r.anomaly, 12), r.kept) for r in rules.judge(d, labels).collect()) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == other and 0 < sum(n for r, n in one.items() if r[3]) < sum(one.values())


# ---- 5 -----------------------------------------------------------------------------------------
def test_secrets_of_rows_without_or_with_repeated_ids(spark):
    token, other = "Zk9x8Qw7Lm6Np5Rt4Yv3", "Qq1Ww2Ee3Rr4Tt5Yy6Uu"
    rows = [(None, f"a {token} b", "s1"), (7, f"long harmless words before {other}", "s2"), (7, f"{other} long harmless words behind it", "s2"), (8, "no secret at all in here", "s3"), (None, "nothing", "s1")]
    docs = frame(spark, rows).withColumns({"found": F.lit(1), "_id": F.lit(2), "content": F.lit("c"), "row": F.lit(3), "spans": F.lit("s")})
    scanned = secrets.scan(docs)
    assert Counter((r.doc_id, r.spans, r.n_live) for r in scanned.collect()) == Counter([(None, "random:2:22", 1), (7, "random:27:47", 1), (7, "random:0:20", 1), (8, "", 0), (None, "", 0)])
    masked = secrets.redact(docs, scanned)
    assert masked.columns == docs.columns
    assert {r.text for r in masked.collect()} == {"a [SECRET] b", "long harmless words before [SECRET]", "[SECRET] long harmless words behind it", "no secret at all in here", "nothing"}


def test_owners_and_repositories_are_counted_apart(spark):
    widely, at_home, twice = "Zk9x8Qw7Lm6Np5Rt4Yv3", "Qq1Ww2Ee3Rr4Tt5Yy6Uu", "Aa1Ss2Dd3Ff4Gg5Hh6Jj"
    rows = [(k, f"x {widely} {widely}", f"src{k}") for k in (1, 2, 3)] + [(10 + k, f"x {at_home}", f"src{4 * k}") for k in range(5)] + [(20 + k, f"x {twice}", f"src{k}") for k in (1, 2)]
    scanned = secrets.scan(frame(spark, rows), owner=F.expr(secrets.GROUP))
    assert {r.doc_id: r.n_live for r in scanned.collect()} == {1: 0, 2: 0, 3: 0} | dict.fromkeys((*range(10, 15), 21, 22), 1)
    raw = spark.createDataFrame([(k, r, o, [(0, 20, "random", b"v")] * 2) for k, r, o in ((1, "a", "x"), (2, "a", "x"), (3, "b", None))], f"row long, repository string, owner string, base {secrets.SPAN_TYPE}")
    assert [tuple(r)[1:] for r in secrets.ownership(raw.withColumn("more", F.col("base"))).collect()] == [(3, 2, 2, True)]


def test_more_spans_take_time_in_proportion():
    draw = random.Random(2)
    text = " ".join("".join(draw.choices("ABCDEFGHabcdefgh0123456789", k=24)) for _ in range(20_000))
    started = time.time()
    found = secrets.more_spans(text, secrets.base_spans(text))
    assert len(found) > 15_000 and time.time() - started < 10
    assert found == sorted(found)


# ---- 7 -----------------------------------------------------------------------------------------
def test_mixing_leaves_columns_of_its_own_names_alone(spark):
    docs = frame(spark, [(k, "a b c", f"src{k % 3}") for k in range(30)])
    clashing = docs.withColumns({c: F.lit(f"own {c}") for c in ("domain", "language", "identity", "leaf_source", "mix_tokens", "copies", "whole", "cutoff", "rest", "bucket", "draw")})
    marked = mixing.marked(clashing, F.lit("d"), {}, 0.5, epochs=1)
    taken = mixing.taken(marked)
    assert taken.columns == clashing.columns
    rows = taken.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in ("domain", "copies", "whole", "cutoff"))
    plain = mixing.mix(docs, F.lit("d"), {}, 0.5, epochs=1).where("copies > 0")
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in plain.collect())
    assert len(set(mixing.mix(clashing, F.lit("d"), {}, 0.5).columns)) == len(mixing.mix(clashing, F.lit("d"), {}, 0.5).columns)


# ---- 2 -----------------------------------------------------------------------------------------
def test_small_partitions_share_a_stream(spark, monkeypatch):
    rows = [(k, f"some words {k} " * (1 + k % 90), "s") for k in range(4000)]
    docs = frame(spark, rows).repartition(20)
    many = [r for r in packing.pack(docs).collect()]
    assert {r.sequence_id >> 32 for r in many} == {0}
    monkeypatch.setattr(packing, "STREAM_DOCUMENTS", 200)
    few = [r for r in packing.pack(docs).collect()]
    share = lambda got: sum(r.length for r in got if r.recut) / sum(r.length for r in got)
    assert len({r.sequence_id >> 32 for r in few}) == 20 and share(many) < share(few)
    assert sum(r.length for r in many) == sum(r.length for r in few)


# ---- pipeline ----------------------------------------------------------------------------------
def tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{TABLES}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_stages_do_what_they_say(spark, tmp_path):
    given = spark.read.parquet(f"{TABLES}/documents.parquet")
    first = given.orderBy("doc_id").first()
    strange = [(None, "a row without an id and with words enough to be a text of its own", "en", "src1", 60), (None, None, None, None, None), (990001, "", "en", "src2", 0),
               (990002, None, "en", None, None), (990003, first.text, first.lang, "src0", first.n_chars), (990004, "token = abcdefgh12345678 stays masked", "en", "src3", 37), (first.doc_id, first.text, first.lang, first.source, first.n_chars)]
    docs = given.union(spark.createDataFrame(strange, given.schema))
    folder, kept = tables(spark, tmp_path / "a", docs), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
            assert docs.select("doc_id", "source").exceptAll(before.select("doc_id", "source").union(before.select("doc_id", "source"))).isEmpty()
    near = kept["ngram_jaccard_join"].collect()
    assert 990003 not in {r.doc_id for r in near} and sum(r.doc_id == first.doc_id for r in near) == 1
    masked = kept["secret_scans"]
    assert masked.count() == len(near) and masked.where("doc_id = 990004").first().text == "[SECRET] stays masked"
    assert kept["source_mixing"].where("doc_id = 990002").isEmpty()
    pieces = kept["packing"].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept["source_mixing"].collect()}
    sizes = Counter()
    for r in pieces:
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= packing.LENGTH
    again = Counter((r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, folder).where("start = 0").collect())
    assert again == Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").limit(0)
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "b", docs)).collect() == []
