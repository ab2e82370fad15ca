"""Line dedup, substring dedup, exact dedup, near-dedup and decontamination against brute force, with edge cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from specula.llm import decontaminate, exact_dedup, graph, line_dedup, near_dup, substring_dedup
from tests.llm import brute

CLASHING = "doc_id LONG, text STRING, id STRING, n INT, key STRING, lines INT, row INT, component STRING, spans INT, first INT"


def docs(spark, rows, clashing=True):
    full = [(i, t, "x", 1, "k", 2, 3, "c", 4, 5) for i, t in rows]
    df = spark.createDataFrame(full, CLASHING)
    return df if clashing else df.select("doc_id", "text")


def corpus(seed, n=60, vocabulary=400, length=120):
    """Texts with shared lines and passages, near and exact copies, long and short ones, and all kinds of nothing."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    shared = [[word() for _ in range(r.randrange(15, 50))] for _ in range(4)]
    out = []
    for i in range(n):
        if out and r.random() < 0.35:
            w = r.choice(out)[1].split(" ")
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(r.randrange(1, length))]
        if r.random() < 0.5:
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(shared)
        if r.random() < 0.2:
            w += ["again"] * r.randrange(1, 45)
        out.append((i, " ".join(w)))
    out = [(i, t.replace("w1", "\nw1")) for i, t in out]
    return out + [(n, None), (n + 1, ""), (n + 2, " \n\t \n\n\n "), (n + 3, out[0][1]), (n + 4, "one"), (n + 5, " ".join(word() for _ in range(30_000)))]


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(spark, seed):
    rows = corpus(seed)
    got = {r["id"]: r for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    want = brute.lines_kept(rows)
    assert {i: r["text"] for i, r in got.items()} == want
    n = dict(rows)
    assert all(r["n_lines"] - r["n_removed"] == (0 if n[i] is None else len(want[i].split("\n")) if r["n_lines"] != r["n_removed"] else 0) for i, r in got.items())


def test_line_dedup_keeps_other_columns_and_empty_tables(spark):
    d = docs(spark, [(2, "a\nb\nc\nd"), (1, "x\na\nb\nc"), (3, "a\nb"), (None, "q"), (4, "a\r\nb\nc")])
    out = line_dedup.line_dedup_rows(d)
    assert out.columns == d.columns and {r["doc_id"]: r["text"] for r in out.collect()} == {1: "x\na\nb\nc", 2: "d", 3: "a\nb", None: "q", 4: "a\r\nb\nc"}
    assert line_dedup.line_dedup(d.limit(0)).count() == 0
    twice = docs(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (5, "a\nb\nc")])
    assert sorted((r["id"], r["text"]) for r in line_dedup.line_dedup(twice).collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (5, "")]


@pytest.mark.parametrize("seed", range(4))
def test_substring_dedup(spark, seed):
    rows = corpus(seed, n=80)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.substring_dedup(docs(spark, rows).repartition(5)).collect()}
    assert got == brute.spans_kept(rows, 20)


@pytest.mark.parametrize("window", [5, 12, 33])
def test_substring_dedup_of_runs_and_periods(spark, window):
    r = random.Random(window)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(1, 90)))) for i in range(25)]
    rows += [(90, "a " * 200), (91, "a b " * 150), (92, "a b c " * 100), (93, "x " * (window - 1)), (94, "x " * window), (95, "x " * window)]
    got = {d["doc_id"]: (d["n_words"], d["n_removed"], d["text"]) for d in substring_dedup.substring_dedup(docs(spark, rows, False), window).collect()}
    assert got == brute.spans_kept(rows, window)


def test_a_hot_phrase_in_different_surroundings(spark):
    """One phrase in every text: each text has another context of its names, and none of them gathers in one place."""
    phrase = " ".join(f"hot{k}" for k in range(16))
    rows = [(k, " ".join([*(f"w{k}x{j}" for j in range(12)), phrase, *(f"v{k}y{j}" for j in range(12 + k % 5))])) for k in range(400)]
    rows += [(500, rows[3][1]), (501, "lead " + phrase + " same tail of words"), (502, "lead " + phrase + " same tail of words")]
    df = docs(spark, rows, False).repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.substring_dedup(df).collect()}
    assert got == brute.spans_kept(rows, 20)
    anchors = substring_dedup._anchors(df.selectExpr("doc_id", "text"), 20)
    assert anchors.groupBy("name").count().agg(F.max("count")).first()[0] > 300
    assert anchors.groupBy("key").count().agg(F.max("count")).first()[0] <= 8  # two rows a batch


def test_substring_dedup_edges(spark):
    t = " ".join(map(str, range(25)))
    rows = [(7, t), (7, t), (None, None), (9, t + "  tail"), (8, "é ü\x0bz")]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.substring_dedup(docs(spark, rows)).collect())
    assert got == [("7", 25, 0, t), ("7", 25, 0, t), ("8", 2, 0, "é ü z"), ("9", 26, 25, "tail"), ("None", 0, 0, "")]
    assert substring_dedup.substring_dedup(docs(spark, rows).limit(0)).count() == 0


def test_exact_dedup(spark, tmp_path):
    rows = [(3, "A b"), (9, "a B"), (5, None), (6, ""), (7, "É"), (8, "é"), (None, "a b"), (4, "x" * 200_000)]
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"])) for r in exact_dedup.dedup(docs(spark, rows), index).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    assert got[3] == (9, 3, False, sha("a b")) and got[9] == (9, 3, True, sha("a b")) and got[None] == (9, 3, False, sha("a b"))
    assert got[5] == (6, 2, False, sha("")) and got[6][2] and got[7][2] and got[8][2] and got[4] == (4, 1, True, sha("x" * 200_000))
    more = [(100, "a b"), (101, "new"), (102, "NEW")]
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    got = {r["id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.dedup(docs(spark, more), again).collect()}
    assert got == {100: (9, False), 101: (102, False), 102: (102, True)} and again.table().count() == 6
    assert exact_dedup.dedup(docs(spark, more).limit(0), again).count() == 0
    twice = exact_dedup.DigestIndex(spark, str(tmp_path / "twice"), 2)
    assert [r["kept"] for r in exact_dedup.dedup(docs(spark, [(1, "q"), (1, "q")]), twice).collect()] == [True, True]
    twice.drop()
    assert not (tmp_path / "twice").exists() and not spark.catalog.tableExists(twice.name)


def test_index_is_bucketed(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    index.append(spark.createDataFrame([(bytearray(b"a"), 1, 1)], "digest BINARY, keep_id LONG, n_rows LONG"))
    batch = spark.createDataFrame([(bytearray(b"a"), 5, 1), (bytearray(b"b"), 6, 1)], "digest BINARY, keep_id LONG, n_rows LONG")
    for found in (index.fresh(batch), index.held(batch)):
        scan = found._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in scan and scan.count("Exchange hashpartitioning") == 1  # of the batch alone
    assert [r["keep_id"] for r in index.fresh(batch).collect()] == [6] and [r["keep_id"] for r in index.held(batch).collect()] == [1]
    about = {r[0]: r[1] for r in spark.sql(f"DESCRIBE EXTENDED {index.name}").collect()}
    assert about["Num Buckets"] == "4" and about["Sort Columns"] == "[`digest`]"


def test_scattered_items_are_found(spark):
    """Items in three parts with other words between: most of their shingles stand there, not in one place."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(7))
    items = [(k, " ".join(word() for _ in range(60))) for k in range(40)]
    texts = []
    for k, t in items:
        w = t.split()
        between = lambda: [word() for _ in range(400)]
        texts.append((k, " ".join([*between(), *w[:20], *between(), *w[20:40], *between(), *w[40:]])))
    texts.append((99, " ".join([word() for _ in range(60_000)] + items[7][1].split())))
    found = decontaminate.find_contained(docs(spark, texts, False), spark.createDataFrame(items, "item_id LONG, text STRING")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    want = {(d, i) for d, i, *_ in brute.contained(texts, items)}
    assert got <= want and (99, 7) in got and len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("seed,width,percent", [(0, 3, 85), (1, 5, 80), (2, 3, 85), (3, 2, 70)])
def test_near_duplicates(spark, seed, width, percent):
    rows = corpus(seed, n=90)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs(spark, rows), width, percent).collect()}
    assert got == brute.components(rows, width, percent)


def test_a_large_group_whose_members_differ(spark):
    """Copies with one to seven edits: most pairs are under the threshold, and buckets are large."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(220):
        w = list(base)
        for k in r.sample(range(150), r.randrange(1, 8)):
            w[k] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(300 + i, rows[i][1]) for i in range(40)]  # exact copies of some
    got = {d["id"]: (d["n_shingles"], d["component_id"]) for d in near_dup.near_duplicates(docs(spark, rows, False), 3, 85).collect()}
    assert got == brute.components(rows, 3, 85)


@pytest.mark.parametrize("families", [1, 15])
def test_the_last_round_leaves_out_no_link(spark, families):
    """Close families in one large bucket; each class is a component, so every link must be among the pairs, the centre's too."""
    r = random.Random(families)
    sets = {}
    for f in range(families):
        base = [1000 * f + i for i in range(95)]
        for k in range(2):
            sets[2 * f + k] = set(base) | {100_000 + 1000 * (2 * f + k) + i for i in range(5)}
        if families > 1:
            for k in range(2):
                sets[1000 + 2 * f + k] = set(r.sample(base, 90)) | set(r.sample(range(5000, 5040), r.randrange(1, 12)))
    count = {}
    for s in sets.values():
        for x in s:
            count[x] = count.get(x, 0) + 1
    own = {i: sum(count[x] == 1 for x in s) for i, s in sets.items()}
    held = spark.createDataFrame([(1, i, len(s), own[i], i) for i, s in sets.items()], "key LONG, id LONG, n LONG, own LONG, component LONG")
    weight = held.select("id", F.lit(1).alias("w"))
    full = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id LONG, shingles ARRAY<LONG>")
    got = {(p["id"], p["other"]) for p in near_dup._rest(held, weight, full, 85).collect()}
    linked = {(a, b) for a in sets for b in sets if a > b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert linked and linked <= got


def test_near_duplicate_edges(spark):
    d = docs(spark, [(1, "A b"), (2, "a B"), (3, ""), (4, None), (None, "a b"), (5, "a b c d"), (5, "a b c d"), (6, "\x1c")])
    got = sorted((str(r["id"]), r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(d, 3, 85).collect())
    assert got == [("1", 1, 1), ("2", 1, 1), ("3", 0, 3), ("4", 0, 4), ("5", 2, 5), ("5", 2, 5), ("6", 1, 6), ("None", 1, None)]
    assert near_dup.near_duplicates(d.limit(0), 3, 85).count() == 0


def test_collections_keep_the_miss_small():
    for percent in (80, 85, 95):
        m, q = near_dup.collections_for(percent), (percent / 100) ** near_dup.H
        assert (1 - q) ** m + m * q * (1 - q) ** (m - 1) <= near_dup.MISS


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200 + r.randrange(30), 200 + r.randrange(30)) for _ in range(20)]
    up = {x: x for e in links for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(links, "u LONG, v LONG")).collect()}
    assert got == {x: root(x) for e in links for x in e if e[0] != e[1]}
    assert graph.components(spark.createDataFrame([], "u LONG, v LONG")).count() == 0


def benchmark(seed):
    r = random.Random(seed)
    items = [(j, " ".join(f"i{r.randrange(5000)}" for _ in range(r.choice([2, 4, 5, 9, 20, 33, 60, 150])))) for j in range(24)]
    rows = []
    for i in range(50):
        w = [f"d{r.randrange(3000)}" for _ in range(r.randrange(1, 3000 if i % 9 == 0 else 200))]
        for j in r.sample(range(24), r.randrange(0, 3)):
            part = items[j][1].upper().split(" ") if r.random() < 0.5 else items[j][1].split(" ")
            if len(part) > 40 and r.random() < 0.6:
                part[r.randrange(len(part))] = "changed"
            at = r.randrange(len(w) + 1)
            w[at:at] = part[: r.choice([len(part), len(part), len(part) // 2])]
        rows.append((i, " ".join(w)))
    return rows + [(60, None), (61, ""), (62, items[0][1])], items + [(90, None), (91, ""), (92, items[3][1])]


@pytest.mark.parametrize("seed", range(3))
def test_decontamination(spark, seed):
    rows, items = benchmark(seed)
    held = spark.createDataFrame(items, "item_id LONG, text STRING")
    got = {tuple(r) for r in decontaminate.find_contained(docs(spark, rows), held).collect()}
    assert got == brute.contained(rows, items)
    left = decontaminate.decontaminate(docs(spark, rows), held)
    assert left.columns == docs(spark, rows).columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({i for i, _ in rows} - {g[0] for g in got})


def test_decontamination_in_blocks_and_of_nothing(spark, monkeypatch):
    rows, items = benchmark(9)
    held = spark.createDataFrame(items, "item_id LONG, text STRING")
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 200)
    got = {tuple(r) for r in decontaminate.find_contained(docs(spark, rows), held).collect()}
    assert got == brute.contained(rows, items)
    assert decontaminate.decontaminate(docs(spark, rows), held).count() == len(rows) - len({g[0] for g in got})
    assert decontaminate.find_contained(docs(spark, rows), held.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs(spark, rows), held.limit(0)).count() == len(rows)
    assert decontaminate.find_contained(docs(spark, rows).limit(0), held).count() == 0
    null = docs(spark, [(None, items[4][1]), (1, items[4][1]), (1, items[4][1])])
    assert sorted(map(str, (r["doc_id"] for r in decontaminate.find_contained(null, held.filter("item_id = 4")).collect()))) == ["1", "1", "None"]


def test_hashes_of_words_and_ranges():
    import numpy as np

    from specula.llm.tokens import Lane, words

    lane, plain = Lane(1, True), Lane(1, False)
    texts = ["Ab ab", "", " x\tAb\x0b", "é  y z"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    starts, ends, firsts = words(data, offsets)
    assert np.diff(firsts).tolist() == [len(brute.words(t)) for t in texts]
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == [w for t in texts for w in brute.words(t)]
    h, p = lane.words(data, starts, ends), plain.words(data, starts, ends)
    assert h[0] == h[1] == h[3] and p[0] != p[1] and p[0] == p[3] and len(set(h.tolist())) == 5
    r = lane.running(h)
    one = lane.ranges(r, np.array([0, 1, 0]), np.array([1, 2, 2]))
    assert one[0] == one[1] != one[2]


def test_sizes_do_not_matter_for_where_rows_are(spark):
    rows = corpus(8, n=50)
    one = substring_dedup.substring_dedup(docs(spark, rows).coalesce(1)).orderBy("doc_id").collect()
    assert one == substring_dedup.substring_dedup(docs(spark, rows).repartition(13, F.rand(1))).orderBy("doc_id").collect()
