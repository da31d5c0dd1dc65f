"""Operators 11 to 13 against brute force: nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, decontamination, merkle, order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, position int, tree string, words string, row long, `key` string"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sealed(*values) -> str:
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


# ---- 11 ----------------------------------------------------------------------------------------
def documents():
    draw = random.Random(5)
    rows = [(i, f"line {i}\nnext é {draw.random()}", "en", f"s{i % 4}" if i % 3 else "hot", i) for i in range(900)]
    rows += [(None, "no id\n", "de", "hot", 1), (None, None, None, None, None), (950, "", "en", None, 0), (951, None, "en", "alone", None)]
    rows += [(5, "other text\n", "en", "s1", 2), (7, rows[7][1], "en", "s3", 7), (7, rows[7][1], "en", "s3", 7), (960, "x\n" * 200_000, "fr", "é", 400_000)]
    return rows


def tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for level in levels[:-1]:
        run = at - at % 3
        out.append((level[run:at], level[at + 1 : run + 3]))
        at //= 3
    return out


def test_manifest_equals_plain_trees(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r[:2], r[2], r[3], r[4], 1, "t", "w", 1, "k") for r in rows], SCHEMA).repartition(5)
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        changed = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        groups[source].append(((i is not None, i or 0, sealed(i, source, lang, n, text)), i, sealed(i, source, lang, n, changed)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([m[0][2] for m in sorted(groups[s])]) for s in names}
    trunk = tree([trees[s][-1][0] for s in names])
    want = []
    for k, s in enumerate(names):
        for at, (place, i, tampered) in enumerate(sorted(groups[s])):
            path = siblings(trees[s], at) + siblings(trunk, k)
            node = tampered
            for left, right in path:
                node = sha(*left, node, *right)
            want.append((i, place[2], trees[s][-1][0], trunk[-1][0], sha(*(x for pair in path for side in pair for x in side)), node))
    found = merkle.manifest(docs)
    told = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    got = found.select("doc_id", "leaf", "subroot", "root", told, merkle.fold(F.col("tampered"), F.col("path")))
    assert Counter(map(tuple, got.collect())) == Counter(want)
    # Whoever holds a leaf and its path comes to the root.
    assert found.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()


def test_manifest_of_nothing_and_of_one_document(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty).collect() == []
    one = merkle.manifest(spark.createDataFrame([(1, "a", "en", "s", 1, 1, "t", "w", 1, "k")], SCHEMA)).collect()
    assert [(r.leaf, r.subroot, r.root, r.path) for r in one] == [(sealed(1, "s", "en", 1, "a"),) * 3 + ([],)]


def test_positions_of_a_hot_group(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").alias("g"), (F.col("id") * 7919 % 500).alias("v"))
    placed = order.positions(rows, "g", [F.col("v")], "test").collect()
    for g in (None, "hot"):
        mine = sorted((r.position, r.v) for r in placed if r.g == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
        assert {r.total for r in placed if r.g == g} == {len(mine)}


# ---- 12 ----------------------------------------------------------------------------------------
def fault_of(rows: list[tuple[str, str]], at: int) -> str:
    body = rows[at][1].strip(conversations.BLANKS)
    if not body:
        return "blank"
    return "duplicate" if rows[at] in rows[:at] else "truncated" if body[-1] not in ".!?" else ""


def all_repairs(rows: list[tuple[str, str]]):
    """Every edit of up to two insertions a gap, plainly."""
    gaps = [()] + [(x,) for x in "ua"] + list(itertools.product("ua", repeat=2))
    choices = []
    for at in range(len(rows)):
        fault, one = fault_of(rows, at), [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault == "truncated" else 0
            one += [("K", extra, rows[at]), *(("R", 1 + extra, (r, rows[at][1])) for r in ("user", "assistant"))]
        choices.append(one)
    for edits in itertools.product(*choices):
        for fills in itertools.product(gaps, repeat=len(rows) + 1):
            audit, cost, said = "", 0, []
            for at in range(len(rows) + 1):
                audit, cost = audit + "I" * len(fills[at]), cost + 5 * len(fills[at])
                said += [("user" if x == "u" else "assistant", "") for x in fills[at]]
                if at < len(rows):
                    audit, cost = audit + edits[at][0], cost + edits[at][1]
                    said += [edits[at][2]] if edits[at][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in said)):
                yield cost, audit, "\n".join(f"{r}:{t}" for r, t in said)


def cheapest(letters: str) -> tuple[int, str]:
    """Shortest path over (row, state) by cost and audit."""
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, audit, row, state = heapq.heappop(heap)
        if row == len(letters) and state in (0, 3):
            return cost, audit
        if (row, state) not in done:
            done.add((row, state))
            for name, price, to, taken in conversations.edits(letters[row] if row < len(letters) else None, state):
                heapq.heappush(heap, (cost + price, audit + name, row + taken, to))


TURNS = "conv_id long, turn long, role string, text string, position int, `key` string, head boolean, conv string, digest string"


def small_conversations():
    draw, rows = random.Random(3), []
    texts = ["Yes.", "No!", "cut off", "", " \t\n", "Why?\n ", "Yes."]
    for c in range(14):
        for t in range(draw.choice([1, 2, 2, 3] if c < 4 else [1, 2])):
            rows.append((c, draw.choice([t, t, None, 3]), draw.choice(["user", "assistant", "system", "tool", None, ""]), draw.choice([*texts, None])))
    return rows + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (50, None, "user", "a."), (50, None, "assistant", "a.")]


def test_repair_is_the_cheapest_of_all(spark):
    rows = small_conversations()
    turns = spark.createDataFrame([(*r, 1, "k", True, "c", "d") for r in rows], TURNS).repartition(3)
    groups = defaultdict(list)
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        groups[c].append(((t is not None, t or 0, role, hashlib.md5(text.encode()).hexdigest()), role, text, t))
    want = []
    for c, members in groups.items():
        said = [(m[1], m[2]) for m in sorted(members)]
        numbers = {m[3] for m in members} - {None}
        faults = Counter(fault_of(said, at) for at in range(len(said)))
        wrong = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        cost, audit, text = min(all_repairs(said))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        want.append((c, gaps, faults["blank"], faults["duplicate"], faults["truncated"], wrong, cost, audit, sha(text)))
    want.append((99, 0, 0, 0, 0, 0, 0, "", sha()))
    got = conversations.repair(turns, spark.createDataFrame([(99,), (None,)], "conv_id long")).collect()
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.mark.parametrize("segment", [3, 64])
def test_segments_of_a_long_conversation(spark, monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    draw = random.Random(segment)
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    said = [(roles[draw.choice("suaao" if k else "s")], draw.choice([f"Turn {k}.", f"Turn {k}.", f"cut {k}", "", "Same."])) for k in range(400)]
    letters = ""
    for at, (role, _) in enumerate(said):
        fault = fault_of(said, at)
        kind = "1234" if fault in ("blank", "duplicate") else "SUAO" if fault else "suao"
        letters += kind["suao".index({"t": "o"}.get(role[0], role[0]))]
    turns = spark.createDataFrame([(1, k, *r) for k, r in enumerate(said)] + [(2, 0, "user", "x" * 300_000 + ".")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.cost, r.audit) for r in conversations.repair(turns.repartition(4)).collect()}
    assert got == {1: cheapest(letters), 2: (2, "D")}
    assert cheapest(letters) == conversations.search(letters, 0, conversations.ENDS)


def test_damage_by_checksum(spark):
    rows = [(c, t, "assistant", f"One {c}. Two {t}!") for c in range(30) for t in range(3)] + [(None, None, None, None)]
    got = Counter(map(tuple, conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (c, t)).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        want[c, t, "user" if kind == 4 else role, text] += {0: 0, 3: 2}.get(kind, 1)
    assert got == +want


def test_no_conversations(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversations.repair(empty, empty).collect() == []


# ---- 13 ----------------------------------------------------------------------------------------
FOLD = str.maketrans(decontamination.UPPER, decontamination.LOWER)


def words(text: str | None) -> list[str]:
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (text or "").translate(FOLD))


def benchmark():
    draw = random.Random(9)
    say = lambda n: " ".join(f"{draw.choice(['what', 'is', 'the', 'é', 'Größe'])}{draw.randrange(6)}" for _ in range(n))
    texts = [say(25), say(12), say(10), say(9), say(6), "only this", "x", say(60), None, "", "--", "same " * 14, "Only THIS!"]
    return [*enumerate(texts), (0, say(11)), (None, say(13))]


def pages():
    items = [t for _, t in benchmark() if t]
    filler = lambda k, n: " ".join(f"w{k}x{i % 97}" for i in range(n))
    rows = [(k, filler(k, 20) + "\n" + t + ", " + filler(k, 20)) for k, t in enumerate(items)]
    rows += [(100, items[0].upper()), (101, " ".join(items[0].split()[5:18]) + "; " + " ".join(items[0].split()[9:25])), (102, " ".join(items[0].split()[:9]))]
    rows += [(103, None), (104, ""), (105, "x"), (106, "--- !"), (107, "same " * 500), (108, filler(1, 60_000) + " " + items[1]), (109, "y" * 300_000 + " " + items[2])]
    rows += [(110, items[4].replace(" ", "_")), (111, "Only-this"), (5, filler(3, 9)), (None, items[7]), (None, None), (100, items[0].upper()), (112, " ".join(items) * 3)]
    return rows


def judged(rows, items):
    out = []
    sized = [(str(i) if i is not None else "null", words(t)) for i, t in items]
    for i, text in rows:
        w, hit, held = words(text), set(), set()
        for name, item in sized:
            n = min(len(item), 10)
            grams = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    held.add(name)
        out.append((i, len(w), len(hit), tuple(sorted(held))))
    return Counter(out)


@pytest.mark.parametrize("small", [True, False])
def test_contamination_is_exact(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
        monkeypatch.setattr(decontamination, "FILTER_BITS", 1 << 15)
    docs = spark.createDataFrame([(*r, "en", "s", 1, 1, "t", "w", 1, "k") for r in pages()], SCHEMA).repartition(4)
    items = spark.createDataFrame([(*r, "x", 1) for r in benchmark()], "item_id long, text string, words string, n int")
    got = decontamination.contamination(docs, items).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == judged(pages(), benchmark())
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit and all(a.end < b.start for a, b in itertools.pairwise(r.spans)) for r in got)


def test_contamination_without_rows_or_items(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.contamination(docs, none).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in got} == {(1, 3, 0, 0), (2, 0, 0, 0)}
    assert decontamination.contamination(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_words_across_cuts(monkeypatch):
    import pyarrow as pa

    from tidemark.llm import kernels

    texts = ["ab,cd " * 50, "é" * 300, None, "A1b2", "x y", ""]
    whole = decontamination.word_hashes(*kernels.buffers(pa.array(texts)))
    monkeypatch.setattr(kernels, "SPAN", 16)
    parts = decontamination.word_hashes(*kernels.buffers(pa.array(texts)))
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert list(whole[3]) == [0, 100, 101, 101, 102, 104, 104]
