"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import licences, lines, mixing, ngram_join, phrases, pivots, secrets, sharding, spans, tokens, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = ("id", "row_key", "cid", "key", "n", "size", "copies", "line", "words", "shard", "slot", "component_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def words(rng, n):
    return [rng.choice("ab cd éf gh ij kl mn op qr st uv wx yz".split()) + rng.choice("aeiou") + rng.choice("xyz") for _ in range(n)]


def made(seed=0, n=60):
    """Documents with near copies, exact copies, a shared passage, nulls, an empty one, a very long one, a repeated row."""
    rng = random.Random(seed)
    passage, out = words(rng, 30), []
    for i in range(n):
        w = words(rng, rng.choice([3, 8, 40, 80]))
        if i % 4 == 1:
            w = list(out[i - 1][1].split())
            if len(w) > 20 and i % 8 == 1:
                w[rng.randrange(len(w))] = "changed"
        if i % 5 == 2:
            w += passage
        text = " ".join(w)
        out.append((i, text.capitalize() if i % 3 else text.replace(" ", "\n", 2), f"s{i % 4}"))
    out += [(1000, None, "s0"), (1001, "", None), (1002, "  \n\t ", "s1"), (None, out[0][1], None), (1003, " ".join(words(rng, 60_000)), "s2"), (5, out[5][1], out[5][2])]
    return out


@pytest.fixture(scope="module")
def rows():
    return made()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, *["x"] * len(EXTRA)) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return (x is None, x)


# --- 1 --------------------------------------------------------------------------


def test_mix_keeps_targets(docs, rows, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, left, target = sum(size.values()), sorted(size, key=key), {}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(left)}
    due = 1.5 * total
    while True:  # fill, cap, share the excess anew
        level = due / sum(weight[s] for s in left)
        full = [s for s in left if 2 * size[s] < level * weight[s]]
        if not full:
            break
        for s in full:
            target[s], due = 2.0 * size[s], due - 2 * size[s]
            left.remove(s)
    target |= {s: level * weight[s] for s in left}
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= max(5, 0.03 * target[s]) or s == "s2"
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(2)).collect()))
    assert mixing.mix_sources(empty).count() == 0


def test_mix_small_source_beside_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 400)
    rng = random.Random(4)
    small = [(i, "w " * rng.randint(50, 600), "small") for i in range(200)] + [(999, "w " * 20_000, "small")]
    got = mixing.mix_sources(frame(spark, small + [(2000 + i, "w " * 100, "big") for i in range(1000)]), weights=(1,), share=0.74, cap=2.0).collect()
    for name in ("small", "big"):
        own = [r for r in got if r.source == name]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target


def test_landing_turns_over_until_on_target():
    size = np.array([20_000, *range(50, 250)])
    given = np.full(201, 0.37)
    prob = np.array([0.5] + [1.0, 0.0] * 100)
    out = mixing.landing(size, prob, given)
    assert abs((out * size).sum() - (prob * size).sum()) <= 50 and not ((out > 0) & (out < 1)).any()


def test_flight_balances():
    rng = np.random.default_rng(1)
    size, prob = rng.integers(1, 500, 800), np.full(800, 0.37)
    out = mixing.flight(size, prob, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(prob.sum()) and (out * size).sum() == pytest.approx((prob * size).sum())


# --- 2 --------------------------------------------------------------------------


def test_secrets_match_plain_regex(spark, empty):
    texts = ["PassWord = 'abcdef12' token:short api_key=ABCDEFGH", "AKIA" + "A1" * 10 + " AKIASHORT", "x" + "0af3" * 7, "é𝒳 secret=abcdefg token = zzzzzzz", None, "", "none", "password=abcdef" * 3, "ghp_" + "a" * 36]
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s")])
    plain = [(k, re.compile(p, re.I | re.A if k == "assign" else 0), g, least) for k, p, g, least in ((r.kind, r.pattern, r.group, r.least) for r in secrets.BASE_RULES + secrets.MORE_RULES)]
    got = secrets.find_secrets(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = [(m.start(), i, m.end(), k) for i, (k, p, g, least) in enumerate(plain) for m in p.finditer(texts[r.doc_id] or "") if len(m.group(g)) >= least]
        assert [(s.kind, s.start, s.end) for s in r.spans] == [(k, a, b) for a, _, b, k in sorted(want)]
    assert secrets.find_secrets(empty).count() == 0


def test_trigram_queries():
    q = secrets.trigram_query(secrets.BASE_RULES[0].pattern)
    assert frozenset(["tok", "oke", "ken"]) in q and len(q) == 6
    assert secrets.trigram_query("[0-9a-f]+") == frozenset([frozenset()])
    assert secrets.trigram_query("ab|abcd") == frozenset([frozenset()])
    assert secrets.trigram_query("x(abcd)*ghi") == frozenset([frozenset(["ghi"])])
    assert secrets.trigram_query("x(ab)?gh") == frozenset([frozenset(["xgh"]), frozenset(["xab", "abg", "bgh"])])


# --- 3 --------------------------------------------------------------------------


def shingled(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def near_rows(seed=1):
    """Short texts of few words, and a large group of near copies with edits of their own."""
    rng, base = random.Random(seed), [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(rng.choices(["ab", "cd", "ef", "gh", f"x{i // 5}"], k=rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 20]))), "s") for i in range(200)]
    for i in range(200, 400):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            w[rng.randrange(120)] = f"n{rng.randrange(400)}"
        rows.append((i, " ".join(w[rng.choice([0, 0, 5]) :]), "s"))
    return rows


@pytest.mark.parametrize(("n", "percent", "bits"), [(3, 30, 64), (3, 50, 64), (2, 67, 64), (5, 80, 64), (4, 85, 7)])
def test_ngram_join_of_near_copies(spark, n, percent, bits):
    """Equals brute force at any threshold, also where classes clash in the few bits used."""
    check_ngram_join(frame(spark, near_rows()), near_rows(), n, percent, class_bits=bits)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join_equals_brute_force(docs, rows, n, percent):
    check_ngram_join(docs, rows, n, percent)


def check_ngram_join(docs, rows, n, percent, **options):
    sets = [shingled(t, n) for _, t, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    part = components(len(rows), links)
    least = {}
    for p, (i, _, _) in zip(part, rows, strict=True):
        least[p] = min(least.get(p, (True, None)), key(i), key=lambda x: (x[0], x[1] or 0))
    want = sorted(((key(i), len(s), least[p]) for p, (i, _, _), s in zip(part, rows, sets, strict=True)), key=str)
    got = ngram_join.similar_groups(docs, words=n, percent=percent, **options).collect()
    assert sorted(((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got), key=str) == want
    assert len(links) > 10


def test_ngram_join_large_group_and_empty(spark, empty):
    rng = random.Random(3)
    base = words(rng, 200)
    group = [(i, " ".join(base[: k] + ["new"] + base[k + 1 :]), "s") for i, k in enumerate(rng.choices(range(200), k=150))]
    got = ngram_join.similar_groups(frame(spark, group), words=5, percent=80).collect()
    assert {r.component_id for r in got} == {0}
    assert ngram_join.similar_groups(empty).count() == 0


# --- 4 --------------------------------------------------------------------------


def test_licences(spark, docs, rows, empty):
    mit = licences.TEMPLATES["MIT"][2]
    texts = ["Licensed under the APACHE license,  version 2.0!\nother words here", "x y z\n\n" + mit.replace("hereby ", "") + "\n\nmore", "no licence", None, "", "word"]
    got = {r.doc_id: [x.licence for x in r.licences] for r in licences.find_licences(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {0: ["Apache-2.0"], 1: ["MIT"], 2: [], 3: [], 4: [], 5: []}
    assert licences.find_licences(docs).filter(F.size("licences") > 0).count() == 0
    assert licences.find_licences(empty).count() == 0


def test_licences_within_longer_texts(spark):
    bsd = licences.TEMPLATES["BSD-3-Clause"][1].replace(": Redistributions", ":\n\nRedistributions").replace("disclaimer. Redis", "disclaimer.\n\nRedis").replace(". Neither", ".\n\nNeither")
    code = "\n\n".join(f"def f{k}(x):\n    return x + {k}" for k in range(200))
    short = licences.TEMPLATES["Apache-2.0"][0]
    texts = [bsd + "\n\n" + code, f"This tool reads tables and writes them again. {short} It was made by some of us in spring.", code, f"{short[:20]}", short[21:], code + " " + bsd]
    got = {r.doc_id: {x.licence: x.dice for x in r.licences} for r in licences.find_licences(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got[0]["BSD-3-Clause"] > 0.95 and got[5]["BSD-3-Clause"] > 0.95 and got[1] == {"Apache-2.0": 1.0}
    assert got[2] == got[3] == got[4] == {}


def test_licence_windows_equal_brute_force(spark):
    rng, template = random.Random(8), "a b c a b d e f g a b"
    texts = [" ".join(rng.choice("abcdefgx") if rng.random() < 0.3 else w for w in ("x y " + template + " z " + template).split()) for _ in range(60)]
    pairs = lambda w: set(zip(w, w[1:], strict=False))
    other, want = pairs(template.split()), {}
    for i, t in enumerate(texts):
        w = t.split()
        spans = [w[a:b] for a in range(len(w)) for b in range(a + 2, min(len(w), a + 16) + 1)] + [w]
        want[i] = max(2 * len(pairs(s) & other) / (len(pairs(s)) + len(other)) for s in spans)
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: {x.licence: x.dice for x in r.licences} for r in licences.find_licences(df, templates={"T": [template]}).collect()}
    assert got == {i: {"T": pytest.approx(v)} if v >= 0.8 else {} for i, v in want.items()}
    assert 5 < sum(map(bool, got.values())) < 60


# --- 5 --------------------------------------------------------------------------


def test_phrases_equal_brute_force(spark, docs, rows, empty):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    of = lambda t: split.findall((t or "").translate(LOWER))
    texts = [" ".join(of(rows[2][1])[-14:]), "Changed", None, "", " ".join(of(rows[10][1])[3:9]), rows[2][1]]
    items = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, words string")
    windows = collections.defaultdict(set)
    for i, t in enumerate(texts):
        w = of(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    want = []
    for i, t, _ in rows:
        w, hit, items_hit = of(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    items_hit |= found
        want.append((key(i), len(w), len(hit), sorted(items_hit)))
    got = phrases.find_phrases(docs, items).collect()
    assert sorted(((key(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got), key=str) == sorted(want, key=str)
    assert phrases.find_phrases(empty, items).count() == 0
    assert phrases.find_phrases(docs, items.limit(0)).filter("n_hit > 0").count() == 0


def test_phrases_near_and_exact_equal_sql(spark, tmp_path):
    import duckdb

    from vecloom.llm.queries import op5_decontaminate, oracle_sql

    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [rng.sample(vocabulary, n) for n in (14, 25, 10, 6, 30)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 60])))) for i in range(60)] + [(900, None), (901, "")]
    for i in range(60):
        w = list(passages[i % 5])
        for at in rng.sample(range(len(w)), i // 5 % 4):
            w[at] = rng.choice(["replaced", *vocabulary])
        docs.append((100 + i, " ".join([*rng.choices(vocabulary, k=i % 7), *w, "end"])))
    items = [(i, " ".join(p)) for i, p in enumerate(passages)] + [(7, " ".join([*passages[0][:9], "nowhere", *passages[0][9:]])), (8, "nowhere at all"), (9, None)]
    con = duckdb.connect()
    for name, rows, types in (("documents", docs, "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, types).coalesce(1).write.parquet(f"file://{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got, want = op5_decontaminate(spark, f"file://{tmp_path}"), con.sql(oracle_sql()["op5_decontaminate"])
    assert sorted(got.columns) == sorted(want.columns)
    want = sorted(tuple(r[want.columns.index(c)] for c in got.columns) for r in want.fetchall())
    got = got.collect()
    assert sorted(tuple(r) for r in got) == want
    assert sum(r["n_near_items"] > 0 for r in got) >= 10 and any(r["contaminated"] for r in got)


# --- 6 --------------------------------------------------------------------------


def test_lines_against_brute_force(spark, empty):
    rng, rows = random.Random(5), []
    stock = [" ".join(words(rng, 14)) for _ in range(30)]
    for i in range(40):
        own = [rng.choice(stock) for _ in range(4)] + [" ".join(words(rng, 12))]
        if i % 3 == 0:
            x = rng.choice(stock)
            own.append(x[:20] + "Q" + x[21:])
        rows.append((i, "\n".join([*own, "short"]), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, "a" * 5000 + "\n" + "b" * 30, "s")]
    found = [(d, k, x.strip(" \t\r")) for d, t, _ in rows for k, x in enumerate((t or "").split("\n")) if len(x.strip(" \t\r")) >= 24]
    sets = [frozenset(x[k : k + 8] for k in range(len(x) - 7)) for _, _, x in found]
    part = components(len(found), [(a, b) for a in range(len(found)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    first = {}
    for p, (d, k, _) in zip(part, found, strict=True):
        first[p] = min(first.get(p, (d, k)), (d, k))
    want = collections.defaultdict(list)
    for d, k in first.values():
        want[d].append(k)
    df = frame(spark, rows)
    got = {r.doc_id: r.kept_lines for r in lines.find_lines(df).collect()}
    missed = sum(got[d] != sorted(want[d]) for d in got)
    assert missed <= 1 and len(got) == len(rows)
    assert {r.doc_id: r.kept_lines for r in lines.find_lines(df.union(df.filter("doc_id is null"))).collect()} == got
    cleaned = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    assert cleaned[100] is None and cleaned[101] == "" and all("short" in cleaned[d] for d in range(40))
    assert lines.find_lines(empty).count() == 0


def test_repeated_rows_keep_lines_once(spark, monkeypatch):
    monkeypatch.setattr(lines, "COPIES_PER_TASK", 2)
    text, other = "a line of some length here\nanother line of some length", "a line of some length here\nx"
    rows = [(1, text, "s")] * 6 + [(2, text, "s"), (None, other, "s"), (None, other, "s"), (3, "quite another thing that stands alone", "s")]
    got = sorted((str(r.doc_id), r.long_lines, r.kept_lines) for r in lines.find_lines(frame(spark, rows)).collect())
    assert got == sorted([("1", [0, 1], [1])] + [("1", [0, 1], [])] * 5 + [("2", [0, 1], []), ("None", [0], [0]), ("None", [0], []), ("3", [0], [0])])
    left = sorted((str(r.doc_id), r.text) for r in lines.dedup_lines(frame(spark, rows)).collect())
    assert left == sorted([("1", "another line of some length")] + [("1", "")] * 5 + [("2", ""), ("None", other), ("None", "x"), ("3", rows[-1][1])])


def test_line_recall(spark):
    """Of lines that are similar to an earlier one, the share that goes: lines of every document whose id is divisible by 100, against all."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 1000", "text"))
    rows = df.collect()
    stripped = [(d, k, x.strip(" \t\r")) for d, t in rows for k, x in enumerate((t or "").split("\n"))]
    lists, sets = collections.defaultdict(list), {}
    for d, k, x in stripped:
        if len(x) >= 24 and x not in sets:
            sets[x] = frozenset(x[i : i + 8] for i in range(len(x) - 7))
            for g in sets[x]:
                lists[g].append((d, k, x))
    got = {r.doc_id: set(r.kept_lines) for r in lines.find_lines(df).collect()}
    due = gone = 0
    for d, k, x in stripped:
        if d % 100 == 0 and len(x) >= 24:
            met = collections.Counter(y for g in sets[x] for y in lists[g])
            if any(y[:2] < (d, k) and 100 * c >= 80 * (len(sets[x]) + len(sets[y[2]]) - c) for y, c in met.items()):
                due, gone = due + 1, gone + (k not in got[d])
    assert due > 10 and gone >= 0.9 * due


def test_short_lines_in_the_query(spark, tmp_path):
    from vecloom.llm import queries

    rows = [(0, "Les.\n\nAll rights reserved.\nx", "s"), (1, "Les.\n\n  All rights reserved.\t\ny", "s"), (2, "Les!\n \nx\nAll rights reserved!\nLes!", "s"), (3, None, "s"), (4, "", "s")]
    frame(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_long, r.removed_lines) for r in queries.op6_dedup_lines(spark, f"file://{tmp_path}").collect()}
    assert got == {0: (4, 3, ""), 1: (4, 3, "0,2"), 2: (5, 4, "2,3,4"), 3: (1, 0, ""), 4: (1, 0, "")}


# --- 7 --------------------------------------------------------------------------


def test_pivots_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(60, 16))
    x = np.repeat(centre, 6, axis=0) + rng.normal(size=(360, 16)) * 0.06
    rows = [(i, v.astype(np.float32).tolist(), i // 6 % 3) for i, v in enumerate(x)]
    rows += [(1000, rows[0][1], 0), (1001, None, 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] * 16, 1), (1004, rows[3][1], None), (1005, [1.0, 2.0], 0), (1006, [float("inf")] * 16, 1), (1007, [1.0, None] * 8, 1), (None, rows[6][1], 1), (1008, [], 2)]
    schema = "vec_id long, embedding array<float>, label int, id string, cid string, vector string"
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)
    got = {r.vec_id: r for r in pivots.near_vectors(df).collect()}
    assert len(got) == len(rows)
    v = np.array([r[1] for r in rows[:361]], dtype=float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:361]])
    linked = (v @ v.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    ids = [r[0] for r in rows[:361]]
    want = {i: int(n) for i, n in zip(ids, linked.sum(axis=1), strict=True)}
    for j in np.flatnonzero(v @ v[6] >= 0.98):  # the vector without id
        want[ids[j]] += int(label[j] == 1)
    assert all(got[i].n_links <= want[i] for i in ids)
    assert sum(got[i].n_links for i in ids) >= 0.9 * sum(want.values())
    assert got[1000].component_id == 0 and not got[1000].kept
    for i in (1001, 1002, 1003, 1004, 1005, 1006, 1007, 1008):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert pivots.near_vectors(df.limit(0)).count() == 0


# --- 8 --------------------------------------------------------------------------


def test_toxicity_learns_and_ignores_identity(spark, empty):
    rng, rows, labels = random.Random(7), [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = words(rng, 30)
        if rng.random() < (0.8 if toxic else 0.15):
            w.insert(3, "muslims")
        if toxic:
            w.insert(5, rng.choice(["vilea", "vileb", "vilec"]) + rng.choice("xyz"))
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(toxic), "x"))
    df, known = frame(spark, [*rows, (None, None, "s"), (9000, "", "s")]), spark.createDataFrame([*labels, (None, 1, "x"), (9000, None, "x")], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(df, known).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in range(600))
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert 0 <= got[9000].score < 0.3 and got[None].held_out is False
    neutral = frame(spark, [(0, "the muslims " + " ".join(words(rng, 30)), "s")])
    learnt = known.filter(~toxicity.held_out(F.col("doc_id")))
    with_penalty = toxicity.score(neutral, toxicity.train(df, learnt)).first().score
    without = toxicity.score(neutral, toxicity.train(df, learnt, swap_penalty=0.0)).first().score
    assert with_penalty < without and with_penalty < 0.3
    assert toxicity.score_documents(empty, known).count() == 0
    assert toxicity.score_documents(df, known.limit(0)).select("predicted").distinct().count() == 1
    assert toxicity.keep_below(df, toxicity.train(df, learnt), 0.3).columns == df.columns


# --- 9 --------------------------------------------------------------------------


def test_shards_are_exact_and_uniform(spark, docs, rows, empty):
    got = sharding.shard_documents(docs, n_shards=7).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and sorted(map(len, slots.values()))[-1] - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    crc = {i: zlib.crc32((t or "").encode()) for i, t, _ in rows}
    assert all(r.text_crc32 == crc[r.doc_id] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard_documents(docs.repartition(2), n_shards=7).collect()))
    assert sharding.shard_documents(empty).count() == 0
    whole = sharding.shuffle_into_shards(docs, [F.col("doc_id"), F.col("text")], 4)
    assert whole.count() == len(rows) and whole.columns.count("shard") == 1


def test_many_partitions_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_PARTITION", 50)
    got = sharding.shuffle_into_shards(spark.range(4001), [F.col("id")], 4).collect()
    for s in range(4):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own))) and len(own) in (1000, 1001)
    share = np.mean([r.shard == 0 for r in got if r.id < 1000])
    assert 0.18 < share < 0.32


def test_hypergeometric_law():
    rng = np.random.default_rng(0)
    drawn = [sharding.hypergeometric(rng, 2 * 10**9, 6 * 10**9, 1000) for _ in range(300)]
    assert np.mean(drawn) == pytest.approx(250, abs=3)
    matrix = sharding.communication_matrix([5, 0, 11, 3], 4, 1)
    assert [sum(r) for r in matrix] == [5, 0, 11, 3] and sorted(map(sum, zip(*matrix, strict=True))) == [4, 5, 5, 5]


# --- 10 -------------------------------------------------------------------------


@pytest.mark.parametrize("high", [2, 300, 50_257, 1 << 40, 1 << 63])
def test_words_round_trip(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 59, 60, 61, 5000):
        v = rng.integers(0, high, n, dtype=np.uint64)
        v[: n // 3] = 0
        assert (tokens.decode_words(tokens.encode_words(v), n) == v).all()


def test_token_file_equals_tokenizer(spark, docs, rows, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    odd = ["two  spaces", " lead", "trail ", "a\n\n b", "tab\tx", "nb sp x", "don't 'tis 12.5 <|endoftext|> é,è.", "x\x85y z", "\r\n q", "a <|endoftext|> b", "<|endoftext|>", "two<|endoftext|><|endoftext|> in\na row", "<|endoftext", "|> <|endof text|>"]
    odd += [None, "<|endoftext|>" * 3]
    rng, bits = random.Random(11), ["<|endoftext|>", "<|", "|>", " ", "\n", "word", "don't", "é", "12", ".", "endoftext"]
    odd += ["".join(rng.choices(bits, k=rng.randrange(1, 12))) for _ in range(300)]
    extra = frame(spark, [(2000 + i, t, "s") for i, t in enumerate(odd)])
    all_rows = sorted([*((i, t) for i, t, _ in rows), *((2000 + i, t) for i, t in enumerate(odd))], key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    folder = f"file://{tmp_path}/tokens"
    got = tokens.encode_documents(docs.union(extra), path, folder, end_id=2).collect()
    want, before = [], 0
    for i, t in all_rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, before, len(ids), zlib.crc32(ids.tobytes())))
        before += len(ids)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert sum(len(r.ids) for r in tokens.read_token_ids(spark, folder).collect()) == before
    assert tokens.encode_documents(empty, path, f"file://{tmp_path}/none").count() == 0


# --- shared ---------------------------------------------------------------------


def test_hashes_of_spans():
    data = np.frombuffer(b"abc abcdefghij abc " + b"z" * 300 + b" abcdefghij", dtype=np.uint8)
    start, stop, doc = spans.word_spans(data, np.array([len(data)]), spans.NO_SPACE)
    h = spans.hash_spans(data, start, stop)
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_groups_of_near_copies_are_compared_by_their_nearest_pair_first(spark, monkeypatch):
    from pyspark.sql import functions as F

    from vecloom.llm.common import Workspace

    n, words = 400, [0] * lines.WORDS
    rows = spark.createDataFrame([(0, i, i % 2, [*([3, *words[1:]] if i == 7 else words), 60, 60]) for i in range(n)], "key long, cid long, part long, room array<long>")
    for block in (1024, 50):
        monkeypatch.setattr(lines, "BLOCK", block)
        near = lines._pairs_in_blocks(Workspace(spark, "test"), 80, rows)
        best = near.groupBy("one", "two").agg(F.min(F.struct("apart", "a", "b")).alias("best")).select("best.a", "best.b").collect()
        pairs = near.select("a", "b").collect()
        assert [tuple(r) for r in best] == [(0, 1)]
        assert len(pairs) == len(set(pairs)) == n * n // 4


def test_lines_are_signed_and_verified_without_python(spark, monkeypatch):
    from vecloom.llm.common import Workspace

    plans, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df, name))
    rng = random.Random(11)
    base = "".join(rng.choices("abcdefgh éß😀ж", k=200))
    rows = [(0, base, "s"), (1, base[:100] + "Q" + base[101:], "s"), (2, "".join(rng.choices("xyzw漢字", k=200)), "s"), (3, "".join(c if k % 20 else "#" for k, c in enumerate(base)), "s"), (4, "😀" * 300, "s"), (5, "😀" * 290, "s")]
    got = {r.doc_id: r.kept_lines for r in lines.find_lines(frame(spark, rows)).collect()}
    assert got == {0: [0], 1: [], 2: [0], 3: [0], 4: [0], 5: []}
    assert len(plans) > 10 and not any(word in plan for plan in plans for word in ("Arrow", "Python", "Pandas"))
