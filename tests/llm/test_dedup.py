"""Exact, near-duplicate and passage dedup against brute force."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from threadlens.llm import components, exact_dedup, near_dedup, staging, suffix_dedup, textnum
from tests.llm.conftest import EDGE_ROWS


def test_exact_edges(edge_docs, no_docs):
    got = exact_dedup.exact_dedup(edge_docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in EDGE_ROWS:
        groups.setdefault(norm(t), []).append(i)
    expected = []
    for i, t, *_ in EDGE_ROWS:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        expected.append((i, keep, len(own), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert exact_dedup.exact_dedup(no_docs).collect() == []


def test_exact_hot_group(spark):
    df = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'same text', concat('t', id)) text")
    got = exact_dedup.exact_dedup(df)
    assert got.filter("group_size = 1000 and keep_id = 0").count() == 1000
    assert got.filter("kept").count() == 2001


# --- near duplicates ---------------------------------------------------------------

def _sets(rows):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def _components(sets, percent=85):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x in range(len(sets)):
        i = sets[x][0]
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return [least.get(find(x)) if sets[x][1] else sets[x][0] for x in range(len(sets))]


def near_rows(seed=3):
    rng = random.Random(seed)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 80, 200]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) + 5, " ".join(copy)))
    rng.shuffle(rows)
    return rows


def _check_near(spark, df, rows, percent=85):
    expected = _components(_sets(rows), percent)
    got = near_dedup.near_dedup(df, percent=percent).collect()
    key = lambda i, n, c, k: repr((i, n, c, k))
    assert sorted(key(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == sorted(
        key(i, len(s), c, i == c) for (i, s), c in zip(_sets(rows), expected)
    )


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dups_match_brute_force(spark, percent):
    rows = near_rows()
    _check_near(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows, percent)


def test_near_dups_in_blocks(spark, monkeypatch):
    """Buckets larger than a block are compared as pairs of blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = near_rows(5)
    _check_near(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_near_copies_meet_their_buckets_once(spark, monkeypatch):
    """The rows of the buckets left to compare are joined with their buckets at most once for each search."""
    plans, stage = {}, near_dedup.stage

    def noted(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().analyzed().toString())
        return stage(df, name)

    monkeypatch.setattr(near_dedup, "stage", noted)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rows = near_rows(5)
    _check_near(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows, 80)
    searches = plans["pairs"][1:]
    assert len(searches) >= 2
    for plan in searches:
        assert len(re.findall(r"Join Inner, \(key#", plan)) <= 1
        assert len(re.findall(r"Join Inner, \(class#", plan)) == 1


def test_near_dedup_leaves_no_unread_sketches(spark, monkeypatch):
    """What no later step reads is gone from the shared folder before the result is asked for."""
    stage = staging.stage
    made = []
    monkeypatch.setattr(near_dedup, "stage", lambda df, name: made.append((name, out := stage(df, name))) or out)
    near_dedup.near_dedup(spark.createDataFrame(near_rows(6), "doc_id long, text string"))
    there = {name for name, df in made if all(Path(f.removeprefix("file:")).exists() for f in df.inputFiles())}
    assert {"sketches", "classes", "pairs", "wanted-texts", "labelled-buckets"}.isdisjoint(there)
    assert {"named-rows", "class-components"} <= there


def test_near_dups_between_empty_texts(spark):
    """A text without shingles takes no band keys from its neighbours, nor gives them any."""
    rows = [r for i, (d, t) in enumerate(near_rows(8)) for r in ((d, t), (1000 + i, "" if i % 3 else None))]
    _check_near(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rows)


def test_near_edges(spark, edge_docs, no_docs):
    _check_near(spark, edge_docs, [(i, t) for i, t, *_ in EDGE_ROWS])
    assert near_dedup.near_dedup(no_docs).collect() == []


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (900, 50, 50))
    sets = [np.unique(np.concatenate([common, x])) for x in (a, b)] + [common[:1], common[:3], common[:0]]
    s = near_dedup.sketch(sets)
    assert (s[:4] != near_dedup._EMPTY).all() and (s[4] == near_dedup._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 0.9) < 0.1
    # The order in which documents share a batch doesn't matter.
    assert (near_dedup.sketch(sets[2:4])[0] == s[2]).all()


def test_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "x")]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert set(got.values()) == {"n000", "x"} and len(got) == 43
    assert components.connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def _count_tables(monkeypatch):
    """Names of the tables that components stage from now on."""
    names, staged = [], components.stage
    monkeypatch.setattr(components, "stage", lambda df, name: names.append(name) or staged(df, name))
    return names


def _least_ends(links):
    """{node: least node that its links lead to}, by brute force."""
    root = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


@pytest.mark.parametrize("seed", range(3))
def test_components_match_brute_force(spark, seed):
    """Random links and a tangle of long paths, ends in any order; then links added to what is joined."""
    rng = random.Random(seed)
    links = [(rng.randrange(150), rng.randrange(150)) for _ in range(60)]
    order = rng.sample(range(200, 290), 90)
    links += [*zip(order, order[1:60]), *zip(order[60:], order[61:])]
    links = [(a, b) for a, b in links if a != b]
    more = [(rng.randrange(290), rng.randrange(290)) for _ in range(10)] + [(300, 301)]
    more = [(a, b) for a, b in more if a != b]
    rows = lambda some: spark.createDataFrame([(b"%03d" % a, b"%03d" % b) for a, b in some], "a binary, b binary")
    named = lambda df: {int(bytes(r["node"])): int(bytes(r["root"])) for r in df.collect()}
    roots = components.connected_components(rows(links))
    assert named(roots) == _least_ends(links) and roots.count() == len(_least_ends(links))
    assert named(components.joined_components(roots, rows(more))) == _least_ends(links + more)


def test_components_stop_when_all_are_stars(spark, monkeypatch):
    """One table tells that nothing is left to do; without more links nothing is done at all."""
    names = _count_tables(monkeypatch)
    stars = spark.createDataFrame([("a", f"n{i}") for i in range(50)] + [(f"p{i}", "o") for i in range(9)], "a string, b string")
    roots = components.connected_components(stars)
    assert {r["root"] for r in roots.collect()} == {"a", "o"} and names == ["links", "nodes"]
    assert components.joined_components(roots, stars.limit(0)) is roots and len(names) == 2


# --- passages ---------------------------------------------------------------------------

def _passages(rows):
    """(id, n_bytes, n_removed, n_spans, sha) by looking at every window."""
    out, least = [], {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                least[w] = min(least.get(w, i), i)
    for i, b in data:
        cover = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - 49):
                if least[b[p : p + 50]] < i:
                    cover[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if cover[k] and (not k or not cover[k - 1]))
        kept = bytes(c for c, m in zip(b, cover) if not m)
        out.append((i, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passage_rows(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7)))
    shared = [" ".join(word() for _ in range(n)) for n in (8, 12, 15, 40, 90)] + ["ab" * 60, "x" * 200]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 60)))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(0, len(s) // 2)
            parts += [s[a:], " ".join(word() for _ in range(rng.randrange(0, 9)))]
        rows.append((rng.randrange(1000), "".join(parts)))
    return rows + rows[:3] + [(2000, rows[0][1]), (2001, "short"), (2002, "short")]


@pytest.mark.parametrize("hot_count", [20_000, 2])
def test_passages_match_brute_force(spark, hot_count):
    rows = passage_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.suffix_dedup(df, hot_count=hot_count).drop("kept_text").collect()
    assert sorted(map(tuple, got)) == sorted(_passages(rows))


def test_passages_with_full_bit_tables(spark, monkeypatch):
    """Tables of 64 bits tell next to nothing: every text is kept or fetched, and the result is the same."""
    monkeypatch.setattr(staging, "THIN_BITS", 64)
    rows = passage_rows(5) + [(3000 + i, "one passage that a third of all rows hold, word for word, from end to end") for i in range(40)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot_count=20).drop("kept_text").collect()
    assert sorted(map(tuple, got)) == sorted(_passages(rows))


def test_passages_edges(spark, edge_docs, no_docs):
    got = suffix_dedup.suffix_dedup(edge_docs).drop("kept_text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, _passages([(i, t) for i, t, *_ in EDGE_ROWS])))
    assert suffix_dedup.suffix_dedup(no_docs).collect() == []


def test_equal_windows_finds_the_classes():
    rng = random.Random(4)
    base = [bytes(rng.choice(b"ab") for _ in range(90)) for _ in range(3)]
    parts = [base[rng.randrange(3)] for _ in range(30)]
    parts = [p[: (k := rng.randrange(40, 90))] + bytes([rng.choice(b"abc")]) + p[k + 1 :] for p in parts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    at = np.concatenate([np.arange(90 * i, 90 * i + 41) for i in range(30)])
    group = np.array([rng.randrange(2) for _ in range(30)]).repeat(41)
    found = suffix_dedup.equal_windows(data, at, group.copy())
    windows = [(g, data[a : a + 50].tobytes()) for a, g in zip(at, group)]
    by_class, by_window = {}, {}
    for w, c in zip(windows, found.tolist()):
        assert by_class.setdefault(c, w) == w and by_window.setdefault(w, c) == c


def test_equal_windows_have_equal_anchors():
    text = np.frombuffer(b"some words that go before it, " + b"a passage that both of the documents have in them, more or less" + b" and an end", np.uint8)
    other = np.frombuffer(b"other " + text.tobytes()[30:90] + b" tail of the other one", np.uint8)
    keys = [set(suffix_dedup.anchors(textnum.Chunk(0, 1, x, np.array([0, len(x)])))[3].tolist()) for x in (text, other)]
    assert keys[0] & keys[1]


def test_hot_anchors_arrive_as_few_rows(monkeypatch):
    """A passage of all texts and a long run of one byte: two entries a key and batch, all occurrences counted."""
    monkeypatch.setattr(suffix_dedup, "FOLD_KEYS", 100)
    rng = np.random.default_rng(5)
    passage = bytes(rng.integers(97, 123, 300).astype(np.uint8)).decode()
    texts = [f"{i} " + bytes(rng.integers(97, 123, 80).astype(np.uint8)).decode() + passage for i in range(400)] + ["x" * 20_000, ""]
    tags = suffix_dedup.textnum.mix(np.arange(1, len(texts) + 1, dtype=np.uint64))
    batches = [
        pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array(tags[a:b].view(np.int64)), pa.array(tags[a:b].view(np.int64)), pa.array(texts[a:b])], ["doc_id", "t1", "t2", "text"])
        for a, b in ((0, 150), (150, 401), (401, 402))
    ]
    seen = {}
    for batch in batches:
        for chunk in textnum.chunks(batch.column(3)):
            _, _, _, keys, doc = suffix_dedup.anchors(chunk)
            for key, tag in zip(keys.tolist(), batch.column(1).to_numpy().view(np.uint64)[chunk.first + doc].tolist()):
                seen.setdefault(key >> 21, []).append(tag)
    assert max(map(len, seen.values())) > 10_000
    sent = list(suffix_dedup._send_keys(3)(iter(batches)))
    for batch in sent:
        for row in batch.to_pylist():
            _, n = np.unique(suffix_dedup._unfive(row["keys"]), return_counts=True)
            assert n.max() <= 2
    rows = pa.Table.from_batches(sent)
    hot = set()
    for bucket in range(8):
        mine = rows.filter(pa.compute.equal(rows["bucket"], bucket))
        (found,) = suffix_dedup._repeated_keys(3, 12, 300)(iter(mine.to_batches()))
        part = np.unpackbits(np.frombuffer(found["part"][0].as_py(), np.uint8))
        several = {(key & (1 << 40) - 1) >> 31 for key, t in seen.items() if key >> 40 == bucket and len(set(t)) > 1}
        assert set(np.flatnonzero(part).tolist()) == several
        hot |= set(found["hot"][0].as_py())
    assert {h % (1 << 64) for h in hot} == {key for key, t in seen.items() if len(t) > 300 and len(set(t)) > 1} != set()


def test_copies_that_pass_the_bit_tables_change_no_row(spark, monkeypatch):
    """Tables of 128 bits let many later copies through; each row is still cut once, as its own document."""
    monkeypatch.setattr(staging, "THIN_BITS", 128)
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, texts = word(80), []
    for _ in range(40):
        texts.append(word(60) + passage + word(r.randint(0, 60)))
    rows = [(i, texts[i % 40]) for i in range(120)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = []
    for i, t in rows:
        b = t.encode()
        if i >= 40:
            want.append((i, len(b), len(b), 1))
        else:
            earlier = {texts[k][p : p + 50] for k in range(i) for p in range(len(texts[k]) - 49)}
            lost = {q for p in range(len(t) - 49) if t[p : p + 50] in earlier for q in range(p, p + 50)}
            want.append((i, len(b), len(lost), len([q for q in lost if q - 1 not in lost])))
    assert sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"]) for x in got) == want


def test_readme_states_the_bands():
    from pathlib import Path

    readme = " ".join((Path(__file__).resolve().parents[2] / "README.md").read_text().split())
    at85, at80 = near_dedup.LINKS[85], near_dedup.LINKS[80]
    miss = [f"{(1 - (x.percent / 100) ** x.rows) ** x.bands:.0e}".replace("e-0", "e-") for x in (at85, at80)]
    assert f"{at85.bands} bands of {at85.rows} ({at80.bands} of {at80.rows} for the pipeline's 0.8)" in readme
    assert f"with a probability of {miss[0]} ({miss[1]} at 0.8)" in readme


def test_windows_of_a_common_passage_are_compared_once_for_each_content(spark, monkeypatch):
    rng, staged = random.Random(5), {}
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join([*(word() for _ in range(9)), passage, *(word() for _ in range(9))])) for i in range(60)]
    stage = suffix_dedup.stage

    def recorded(df, name):
        out = stage(df, name)
        staged[name] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "stage", recorded)
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot_count=20).drop("kept_text").collect()
    assert staged["hot-windows"] < 60 * len(passage) / 4
    assert sorted(map(tuple, got)) == sorted(_passages(rows))
