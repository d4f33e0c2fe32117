"""Each operator against brute force on small fixtures: nulls, empty and long texts, copies, ties, odd columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from silvan.llm import buckets, decontam, langid, licenses, lines, packing, phrases, quality, repeats, simhash, toxicity, urls
from silvan.llm.components import components
from silvan.llm.text import alnum_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, place long, fingerprint string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def texts():
    r = random.Random(5)
    base = ["\n".join(sentence(r, r.randint(6, 14)) for _ in range(r.randint(3, 9))) for _ in range(25)]
    near = [t.replace("alpha", "alphas", 1) for t in base[:6]]
    long = " ".join(r.choice(WORDS) + str(r.randint(0, 500)) for _ in range(30_000))
    odd = [None, "", " \n\t ", "one", "One two", "é ü ñ\nünï", "aaaa" * 400, "a b c a b c a b c", "#*$% & | < >", base[0], base[0], base[1] + "\n" + base[2], long, long + " tail"]
    return base + near + odd + [base[3].upper(), "All rights reserved. CC BY! general\npublic license; cc-by cc by"]


@pytest.fixture(scope="module")
def rows():
    rows = [(k, t, "en", "s0" if k % 3 else f"s{k}", len(t or ""), "x", 7, "f") for k, t in enumerate(texts())]
    return rows + [rows[4], rows[4], (None, "null id text here", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    docs.limit(0).write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)


def by_row(df, rows, brute, columns):
    """The multiset of (doc_id, columns) equals what brute force gives for the rows."""
    got = Counter((r.doc_id, *(r[c] for c in columns)) for r in df.collect())
    assert got == Counter((r[0], *brute(r[1])) for r in rows)


def test_quality(docs, rows, empty):
    def brute(t):
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        n = len(words)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {j for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        full = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        failed = n < 50 or 100 * len(hit) > 50 * n
        return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(hit), failed

    by_row(quality.judge(docs), rows, brute, quality.MEASURES[:-1])
    assert quality.judge(docs).filter("kept and base_failed").count() == 0
    assert quality.judge(empty).count() == 0 and quality.clean(empty).count() == 0
    cleaned = quality.clean(docs)
    assert cleaned.columns == docs.columns
    assert cleaned.filter("n_chars <> length(text)").count() == 0


def test_quality_lines(spark):
    r = random.Random(8)
    good = "\n".join(sentence(r, 12) for _ in range(12))
    nav = "\n".join(["Home | News | Sport | About | Contact"] * 1 + [f"Home{k} | News{k} | Sport{k} | About{k} | More{k}" for k in range(20)])
    df = spark.createDataFrame([(1, good), (2, good + "\nWe use cookies. Accept all cookies."), (3, nav)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.judge(df).collect()} == {1: True, 2: True, 3: False}
    assert "cookies" not in quality.clean(df).filter("doc_id = 2").head().text


def test_simhash_fingerprint_follows_its_definition(spark):
    for text in ("", "x", "a B c d", "Some words that are a longer text with more shingles in it"):
        words = text.lower().split()
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        frame = spark.createDataFrame([(s,) for s in shingles], "s string")
        hashes = [r.h & (1 << 64) - 1 for r in frame.select(F.xxhash64("s").alias("h")).collect()]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
        assert simhash.fingerprint(text.encode()) == want


def test_simhash_classes(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = [simhash.fingerprint(r[1].encode() if r[1] else None) for r in rows]
    root = list(range(len(rows)))
    find = lambda k: k if root[k] == k else find(root[k])
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    want = Counter((r[0], f"{prints[k]:016x}", least.get(find(k))) for k, r in enumerate(rows))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(k) for k in range(len(rows))})
    assert simhash.near_duplicates(empty).count() == 0


def test_golay_keys_meet_all_pairs_within_three_bits():
    rng = np.random.default_rng(0)
    u = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    v = u.copy()
    for _ in range(3):
        v ^= np.uint64(1) << rng.integers(0, 64, len(v)).astype(np.uint64)
    golay = simhash.Golay()
    pairs = [set(zip(*(x.tolist() for x in simhash.keys_of(p, golay)), strict=True)) for p in (u, v)]
    assert len({at for _, at in pairs[0] & pairs[1]}) == len(u)


def test_blocked_buckets_and_components(spark):
    rng = np.random.default_rng(0)
    prints = np.unique(rng.integers(0, 2**62, 10)[:, None] ^ (1 << rng.integers(0, 62, (10, 12)))).astype(np.int64)
    rows = spark.createDataFrame([(int(x) % 2, int(x)) for x in prints], "key long, item long")
    classes = [sorted(map(tuple, components(buckets.link_buckets(rows, simhash.forests, simhash.forest, block=b), "a", "b").collect())) for b in (1 << 16, 17)]
    assert classes[0] == classes[1] and classes[0]
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {tuple(r) for r in components(chain, "a", "b").collect()} == {(k, 0) for k in range(41)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(r, a, n):
    b = list(a)
    for _ in range(n):
        k, o = r.randrange(len(b) + 1), r.randint(0, 2)
        if o == 0:
            b.insert(k, r.choice("abc"))
        elif b:
            k = min(k, len(b) - 1)
            b[k : k + 1] = [] if o == 1 else [r.choice("abc")]
    return "".join(b)


def test_edit_distance_and_segments():
    r = random.Random(1)
    for _ in range(4000):
        a = "".join(r.choice("abc") for _ in range(r.randint(1, 30)))
        b = edited(r, a, r.randint(0, 4))
        d = distance(a, b)
        assert all(lines.within(tuple(a), tuple(b), e) == (d <= e) for e in (1, 2, 3))
        one, two = [list(x.encode().replace(b"", b" ").split()) for x in (a, b)]
        like = d <= lines.edits_of(min(len(one), len(two)))
        assert lines.near(tuple(one), tuple(two)) == (like and lines.edits_of(min(len(one), len(two))) > 0)
        if lines.near(tuple(one), tuple(two)):
            keys, owners = lines.keys_of(pa.array([b"left out", b" ".join(one), b" ".join(two)])[1:])
            assert set(keys[owners == 0]) & set(keys[owners == 1])


def test_line_dedup(spark, docs, rows, empty, tmp_path):
    r = random.Random(3)
    base = [WORDS[k % 20] + str(k % 3) for k in range(14)]

    def changed(n):
        line = list(base)
        for _ in range(n):
            at = r.randrange(len(line))
            line[at : at + r.randint(0, 1)] = [r.choice(WORDS)] * r.randint(0, 2)
        return " ".join(line)

    more = [(100 + k, "\n".join(changed(r.randint(0, 2)) for _ in range(3)), *[None] * 6) for k in range(12)]
    every = rows + more
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(every, SCHEMA).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    order = sorted(range(len(every)), key=lambda k: (every[k][0] is None, every[k][0] or 0, k))
    assert [row.doc_id for row in df.collect()] == [row[0] for row in every]
    found = [(k, n, lines.normal(line)) for k in order for n, line in enumerate((every[k][1] or "").encode().split(b"\n")) if line.strip()]
    distinct = sorted({t for *_, t in found})
    words = {t: tuple(t.split()) for t in distinct}
    root = {t: t for t in distinct}
    find = lambda t: t if root[t] == t else find(root[t])
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if abs(len(words[a]) - len(words[b])) <= 2 and lines.near(words[a], words[b]):
                root[find(a)] = find(b)
    size = Counter(find(t) for *_, t in found)
    first, gone, links = {}, {k: [] for k in range(len(every))}, Counter()
    for k, n, t in found:
        links[k] += size[find(t)] - 1
        if find(t) in first:
            gone[k].append((n, first[find(t)]))
        first.setdefault(find(t), every[k][0])
    want = Counter((row[0], (row[1] or "").count("\n") + 1, len(gone[k]), tuple(gone[k]), links[k]) for k, row in enumerate(every))
    got = lines.report(df).collect()
    assert Counter((x.doc_id, x.n_lines, x.n_dropped, tuple(zip(x.dropped, x.kept_in)), x.n_links) for x in got) == want
    assert all((x.class_id is None) <= (x.n_links == 0 or x.doc_id is None) for x in got)
    cleaned = lines.clean(df)
    assert cleaned.columns == df.columns and cleaned.count() == len(every)
    left = Counter((row[0], None if row[1] is None else "\n".join(x for n, x in enumerate(row[1].split("\n")) if n not in dict(gone[k]))) for k, row in enumerate(every))
    assert Counter((x.doc_id, x.text) for x in cleaned.collect()) == left
    assert lines.report(empty).count() == 0


def test_short_lines_go_where_they_repeat(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    rows = [(1, "Home\nAbout us\n\nHome"), (2, " home\nAbout  us\n\nAbout uz"), (3, "Home")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert {x.doc_id: x.dropped for x in lines.report(df).collect()} == {1: [3], 2: [1], 3: [0]}
    assert {x.doc_id: x.text for x in lines.clean(df).collect()} == {1: "Home\nAbout us\n", 2: " home\n\nAbout uz", 3: ""}


def test_normal_lines():
    for raw in (b"", b"a b\nc", b" a b \n\n  c\td\re ", b"a\x0b b\x0cc\n d", "é\u00a0x \n y".encode()):
        assert lines.normal_lines(raw) == [lines.normal(line) for line in raw.split(b"\n")]


def test_lines_with_a_word_replaced_are_near(spark):
    line = "The committee met on Tuesday and agreed to publish the whole report before the summer recess begins."
    rows = [(1, line), (2, line.replace("Tuesday", "Wednesday")), (3, line.replace("whole", "entire").replace("summer", "winter")), (4, line.replace("met", "sat").replace("agreed", "refused").replace("publish", "print"))]
    got = lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_dropped, x.class_id) for x in got} == {1: (0, 1), 2: (1, 1), 3: (1, 1), 4: (0, None)}


@pytest.mark.parametrize("job", ["lines", "repeats", "one_of_each", "packing", "licenses"])
def test_results_do_not_follow_the_splits(spark, sf, job, monkeypatch):
    """Places of rows hold however later jobs would split the files: what was numbered is read from a table."""
    conf = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(conf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    run = {
        "lines": lambda: lines.report(docs),
        "repeats": lambda: repeats.removals(docs),
        "one_of_each": lambda: simhash.one_of_each(docs),
        "packing": lambda: packing.pack(docs, near=True),
        "licenses": lambda: licenses.scan(docs),
    }[job]
    columns = {"packing": ["doc_id", "piece", "n_words"]}.get(job)
    rows = lambda df: Counter(map(str, (df.select(*columns) if columns else df).collect()))
    want = rows(run())
    modules = [m for m in (lines, repeats, simhash, packing, licenses) if hasattr(m, "spool")]
    sizes = iter([20_000, 60_000, 200_000, 10_000] * 20)
    for m in modules:
        def moved(df, name, spool=m.spool, **settings):
            out = spool(df, name, **settings)
            spark.conf.set(conf, str(next(sizes)))
            return out

        monkeypatch.setattr(m, "spool", moved)
    try:
        found = run()
        spark.conf.set(conf, "30000")
        assert rows(found) == want
    finally:
        spark.conf.set(conf, before)


def test_decontamination(spark, docs, rows, empty):
    all_words = [alnum_words((t or "").encode()) for t in texts()]
    items = [(1, " ".join(w.decode() for w in all_words[2][4:24])), (2, "ALPHA beta"), (10, texts()[5]), (11, None), (12, "--"), (13, "never seen words in any text at all they are new here"), (1, "kappa")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = alnum_words(t.encode()) if t else []
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))

    def brute(t):
        w = alnum_words(t.encode()) if t else []
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (who := windows.get(tuple(w[k : k + size]))) is not None:
                    found |= who
                    hit.update(range(k, k + size))
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    by_row(decontam.report(docs, bench), rows, brute, columns)
    by_row(decontam.report(docs, bench, block_words=25), rows, brute, columns)
    assert decontam.report(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.report(empty, bench).count() == 0
    ten = bench.filter("item_id = 10")
    left = decontam.remove_spans(docs, ten, max_coverage=1.0)
    assert left.columns == docs.columns and left.count() == len(rows)
    assert decontam.report(left, ten).filter("contaminated").count() == 0


def test_toxicity(spark, tmp_path):
    r = random.Random(7)
    bad = ["scumword", "trashword", "idiotword", "clownword"]
    text = lambda toxic: " ".join([r.choice(WORDS) for _ in range(30)] + [r.choice(bad) for _ in range(3)] * toxic)
    truth = [(k, int(k % 5 == 0)) for k in range(400)]
    docs = spark.createDataFrame([(k, text(t)) for k, t in truth] + [(900, None), (901, ""), (None, "scumword")], "doc_id long, text string")
    labels = spark.createDataFrame([*truth, (5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs, labels).collect()}
    assert all(got[k].predicted == t for k, t in truth)
    assert all(0 <= x.score <= 1 for x in got.values()) and not got[900].predicted and not got[901].predicted
    assert {x.score for x in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def brute_votes(words, examples, idf, unknown):
    """Vote and nearest examples' cosines of each passage, by the definition."""
    unit = []
    for _, _, own in examples:
        v = {w: (1 + np.log(n)) * idf[w] for w, n in Counter(own).items()}
        length = np.sqrt(sum(x * x for x in v.values())) or 1
        unit.append({w: x / length for w, x in v.items()})
    out = []
    for at in range(0, len(words), toxicity.PASSAGE):
        v = {w: (1 + np.log(n)) * idf.get(w, unknown) for w, n in Counter(words[at : at + toxicity.PASSAGE]).items()}
        length = np.sqrt(sum(x * x for x in v.values())) or 1
        cosines = sorted(((sum(x * u.get(w, 0) for w, x in v.items()) / length, label) for u, (_, label, _) in zip(unit, examples)), reverse=True)
        cosines = [c for c in cosines if c[0] > 1e-12]
        if cosines:
            last = cosines[min(toxicity.NEIGHBOURS, len(cosines)) - 1][0]
            near = [c for c in cosines if c[0] >= last * (1 - toxicity.ROUNDING)]
            share = sum(c * y for c, y in near) / sum(c for c, _ in near)
            out.append((share * min(1, len(near) / min(toxicity.NEIGHBOURS, len(examples))), [c for c, _ in cosines]))
    return out


def test_toxicity_by_brute_force(spark):
    """Document counts, cosines, neighbours, votes and scores of texts with copies, ties and words of their own."""
    r = random.Random(11)
    rare = lambda k: [f"own{k}x{j}" for j in range(r.randint(0, 4))]
    words = {k: [r.choice(WORDS) for _ in range(r.randint(1, 60))] + rare(k) + rare(k // 4) + ["scumword"] * (k % 3 == 0) for k in range(240)}
    words |= {300: [], 301: words[0], 302: words[1], 303: ["nobodyhasthis"], 304: [r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(30_000)]}
    truth = {k: int(k % 3 == 0) for k in range(200)} | {301: 1}
    docs = spark.createDataFrame([(k, " ".join(w), 1.0, k) for k, w in words.items()] + [(5, " ".join(words[5]), 2.0, 0)], "doc_id long, text string, score double, place long")
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    index = toxicity.fit(docs, labels, ~langid.held_out(3, 1))
    texts = [*words.values(), words[5]]
    count = Counter(w for ws in texts for w in set(ws))
    unknown = np.log(len(texts) + 1)
    got = toxicity.score(docs, labels).collect()
    assert sorted(x.doc_id for x in got) == sorted([*words, 5])
    examples = {}
    for x in got:
        if not x.held_out and x.doc_id in truth:
            own = " ".join(words[x.doc_id])
            examples[own, truth[x.doc_id]] = (x.doc_id, truth[x.doc_id], words[x.doc_id])
    examples = list(examples.values())
    assert len(index.ids) == len(examples)
    idf = {w: np.log((len(texts) + 1) / (count[w] + 1)) for _, _, ws in examples for w in ws}
    for x in got:
        found = brute_votes(words[x.doc_id], examples, idf, unknown)
        vote = max((v for v, _ in found), default=-1.0)
        mine = float(index.text_votes([[w.encode() for w in words[x.doc_id]]])[0][0])
        assert abs(mine - vote) < 2e-4
        assert abs(x.score - (min(1, max(0, np.interp(mine, *index.steps))) if mine >= 0 else index.bare)) < 1e-2
        if found and x.doc_id != 304:
            assert any(np.allclose([e.cosine for e in x.evidence], c[: toxicity.SHOWN], atol=1e-5) for v, c in found if abs(v - vote) < 2e-4)


def test_block_bounds_lose_no_neighbour():
    r = random.Random(1)
    examples = [(k, k % 2, [f"w{min(int(r.expovariate(0.05)), 400)}".encode() for _ in range(r.randint(0, 30))]) for k in range(700)]
    idf = {w: 1 + r.random() * 5 for _, _, ws in examples for w in ws}
    index = toxicity.build(examples, idf, 6.0)
    texts = [[f"w{r.randint(0, 500)}".encode() for _ in range(r.randint(0, 40))] for _ in range(150)]
    p, counts = index.passages(texts)
    assert counts.tolist() == [-(-len(t) // toxicity.PASSAGE) for t in texts]
    lean, full = index.products(p), index.products(p, k=10_000)
    for k in (1, 7, toxicity.NEIGHBOURS):
        assert (index.nearest(index.products(p, k), k) == index.nearest(full, k)).all()
    assert (lean == 0).sum() > (full == 0).sum()  # blocks were left out
    skip = np.arange(len(p.norms)) % 700
    assert (index.products(p, skip=skip)[np.arange(len(skip)), skip] == 0).all()


def test_packing(docs, rows, empty):
    got = packing.pack(docs, capacity=64, shard=40).collect()
    pieces, bins = {}, {}
    for x in got:
        pieces[x.doc_id] = pieces.get(x.doc_id, 0) + x.n_words
        if x.bin_id is not None:
            bins.setdefault(x.bin_id, []).append(x)
    want = {}
    for r in rows:
        want[r[0]] = want.get(r[0], 0) + len((r[1] or "").encode().split())
    assert pieces == want
    source = {r[0]: r[3] for r in rows}
    for members in bins.values():
        assert sum(x.n_words for x in members) <= 64
        known = [source[x.doc_id] for x in members if source[x.doc_id]]
        assert len(known) == len(set(known))
        at = 0
        for x in sorted(members, key=lambda x: x.start):
            assert x.start == at
            at += x.n_words
    assert packing.pack(empty).count() == 0 and packing.bins(empty).count() == 0


def test_near_copies_never_share_a_bin(spark, tmp_path):
    from silvan.llm.queries import op5_best_fit_packing

    r = random.Random(9)
    rows = []
    for k in range(20):
        words = [r.choice(WORDS) + str(r.randint(0, 50)) for _ in range(400)]
        rows += [(2 * k, " ".join(words), f"a{k}"), (2 * k + 1, " ".join([*words[:-1], "other"]), f"b{k}")]
    prints = [simhash.fingerprint(t.encode()) for _, t, _ in rows]
    near = [k for k in range(20) if (prints[2 * k] ^ prints[2 * k + 1]).bit_count() <= simhash.MAX_BITS]
    assert len(near) > 10
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    bins = {x.doc_id: x.bin_id for x in op5_best_fit_packing(spark, str(tmp_path)).collect()}
    assert len(bins) == 40 and all(bins[2 * k] != bins[2 * k + 1] for k in near)


def test_best_fit_takes_the_tightest_compatible_bin():
    r = random.Random(2)
    sizes = sorted((r.randint(1, 50) for _ in range(300)), reverse=True)
    sources, clusters = [r.randint(0, 6) for _ in sizes], [r.randint(0, 80) for _ in sizes]
    got, bins = packing.best_fit(sizes, sources, clusters, 50), []
    for n, s, c, b in zip(sizes, sources, clusters, got, strict=True):
        fits = [(room, k) for k, (room, ss, cs) in enumerate(bins) if room >= n and s not in ss and c not in cs]
        want = min(fits)[1] if fits else len(bins)
        assert b == want
        if want == len(bins):
            bins.append((50, set(), set()))
        room, ss, cs = bins[want]
        bins[want] = (room - n, ss | {s}, cs | {c})


def test_repeats(docs, rows, empty):
    raws = [(r[1] or "").encode() for r in rows]
    size = phrases.LENGTH
    counts = Counter(hash(b[i : i + size]) for b in raws for i in range(len(b) - size + 1))

    def brute(t):
        b = (t or "").encode()
        spans = []
        for i in range(len(b) - size + 1):
            if counts[hash(b[i : i + size])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + size
                else:
                    spans.append([i, i + size])
        at, kept = 0, b""
        for s, e in spans:
            kept, at = kept + b[at:s], e
        return len(b), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept + b[at:]).hexdigest()

    by_row(repeats.removals(docs), rows, brute, ("n_bytes", "n_removed", "n_spans", "kept_sha256"))
    assert repeats.removals(empty).count() == 0


def test_corpus_order_is_that_of_the_strings(docs, rows):
    """Suffixes of dictionary phrases and the order of the parse combine into the order of all strings."""
    by_digest = {repeats.digest((r[1] or "").encode()): (r[1] or "").encode() for r in rows}
    got = repeats.corpus_order(docs).orderBy("place").collect()
    strings = [by_digest[r.d1, r.d2][r.start : r.start + phrases.LENGTH] for r in got]
    assert strings == sorted(strings)
    assert len(strings) == sum(max(0, len(b) - phrases.LENGTH + 1) for b in by_digest.values())


def test_phrases_are_free_of_prefixes():
    r = random.Random(3)
    raw = bytes(r.randrange(256) for _ in range(20_000)) + b"abc" * 700
    starts, ends = phrases.parse(raw)
    assert starts[0] == 0 and ends[-1] == len(raw) and (ends[:-1] == starts[1:] + phrases.TRIGGER).all()
    suffixes = sorted(raw[i:e] for s, e, n in zip(starts[:-1], ends[:-1], starts[1:]) for i in range(s, n))
    assert not any(b.startswith(a) and a != b for a, b in zip(suffixes, suffixes[1:]))
    # places depend on the bytes alone
    assert [x - 7 for x in phrases.triggers(b"seventy"[:7] + raw) if x >= 7] == phrases.triggers(raw).tolist()


def test_repeats_in_periodic_and_long_texts(spark):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = word(2000)
    texts = ["De " * 900, "De " * 700, "De " * 300 + "x" + "De " * 300, word(300) + shared[:700] + word(300), word(10) + shared[100:900], shared[399:], "x" * 401, "x" * 400, "y" * 400, shared[:399], "z" + "x" * 399]
    raws = [t.encode() for t in texts]
    size = phrases.LENGTH
    counts = Counter(b[i : i + size] for b in raws for i in range(len(b) - size + 1))
    want = {k: sum(any(counts[b[i : i + size]] > 1 for i in range(max(0, at - size + 1), min(at, len(b) - size) + 1)) for at in range(len(b))) for k, b in enumerate(raws)}
    got = {x.doc_id: x.n_removed for x in repeats.removals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want


def test_licenses(docs, rows, empty):
    def brute(t):
        w = alnum_words((t or "").encode())
        starts, labels = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.encode().split()
            found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            starts += found
            labels |= {label} if found else set()
        return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))

    by_row(licenses.scan(docs), rows, brute, ("n_words", "n_base", "first_word", "last_word", "base_labels"))
    assert licenses.scan(empty).count() == 0


def brute_licenses(text):
    """Labels and score by trying every band of every template at every place of the document."""
    w = alnum_words((text or "").encode())
    pairs = list(zip(w, w[1:]))
    labels, best = set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.encode().split()
        if any(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1)):
            labels.add(label)
            best = 1.0
    for label, template in licenses.TEMPLATES:
        t = alnum_words(template.encode())
        own = list(zip(t, t[1:]))
        matches = [(i, k) for i, x in enumerate(pairs) for k, y in enumerate(own) if x == y]
        for low in {i - k for i, k in matches}:
            band = sorted((i, k) for i, k in matches if low <= i - k <= low + licenses.MAX_SHIFT)
            longest = [1] * len(band)
            for a, (i, k) in enumerate(band):
                for b, (x, y) in enumerate(band[:a]):
                    if x < i and y < k:
                        longest[a] = max(longest[a], longest[b] + 1)
            coverage = max(longest) / len(own)
            if coverage >= licenses.MIN_COVERAGE:
                labels.add(label)
                best = max(best, coverage)
    return ",".join(sorted(labels)), best


def test_license_labels_and_scores_by_brute_force(spark, docs, rows):
    r = random.Random(8)
    texts = ["", None, "licensed under " + "under the x " * 40 + "we the mit dean"]
    for _ in range(60):
        words = r.choice(licenses.TEMPLATES)[1].split()
        for _ in range(r.randint(0, 8)):
            at = r.randrange(len(words))
            words[at : at + r.randint(0, 2)] = [r.choice(["the", "of", "new"])] * r.randint(0, 2)
        texts.append(" ".join(r.choice(WORDS) for _ in range(r.randint(0, 20))) + " " + " ".join(words) + " " + " ".join(r.choice(licenses.TEMPLATES)[1].split()[: r.randint(0, 9)]))
    df = spark.createDataFrame([(k, t, k, "x") for k, t in enumerate(texts)] + [(3, texts[3], 0, "x")], "doc_id long, text string, place long, labels string")
    got = licenses.scan(df).collect()
    assert len(got) == len(texts) + 1
    for x in got:
        labels, best = brute_licenses(texts[x.doc_id])
        assert x.labels == labels and abs(x.score - best) < 1e-12
    assert {x.labels for x in got if x.doc_id == 2} == {""}
    by_row(licenses.scan(docs), rows, brute_licenses, ("labels", "score"))


def test_license_templates_with_edits(spark):
    notice = "Permission is hereby granted, without any fee, free of charge, to any person obtaining a copy of this software and its associated documentation files (the 'Software'), to deal in the Software without restriction"
    docs = spark.createDataFrame([(1, "Hello. " + notice), (2, "Any person may deal in goods of this kind without charge.")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert got[1][0] == "mit" and got[1][1] >= 0.7 and got[2] == ("", 0.0)


def test_urls(spark):
    cases = {
        "https://a.com/en/1": ("a.com", "/en/1", "com/en/", "block"),
        "http://X.Example.COM/en/77?q#f": ("x.example.com", "/en/77", "example.com/en/7", "allow"),
        "http://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
        "http://xexample.net/de/8": ("xexample.net", "/de/8", "net/de/", "allow"),
        "ftp://org": ("org", "", None, "allow"),
        "http://a.org/ES/": ("a.org", "/ES/", None, "allow"),
        "http://b.io/casino/x": ("b.io", "/casino/x", None, "block"),
        "no scheme": ("", "", None, "block"),
        "": ("", "", None, "block"),
        "http://a.b://c/d": ("a.b:", "//c/d", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(cases)] + [(90, None, None, None), (0, next(iter(cases)), None, None)], "page_id long, url string, host string, rule string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urls.judge(pages).collect())
    want = [(k, h, p, r or "", v) for k, (h, p, r, v) in enumerate(cases.values())]
    assert got == sorted([*want, want[0], (90, "", "", "", "block")])
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_rules_without_a_token(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.org/--"), (3, None)], "page_id long, url string")
    rules = [urls.Rule(None, "block", (), r"/--$", 0), urls.path_rule("allow", "com/")]
    want = {1: ("com/", "allow"), 2: (None, "block"), 3: (None, "block")}
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules).collect()} == want
    monkeypatch.setattr(urls, "MAX_BROADCAST", 1)
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules).collect()} == want


def test_url_sql(spark, sf):
    import duckdb

    from silvan.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{sf}/pages.parquet'")
    got = sorted(map(tuple, queries.op8_url_filters(spark, sf).collect()))
    assert got == sorted(con.sql(queries.oracle_sql()["op8_url_filters"]).fetchall())


def test_language_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_language_edges_and_mixtures(spark):
    r = random.Random(4)
    make = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    one, two = WORDS[:10], ["wasser", "feuer", "straße", "über", "zwischen", "schnell", "nicht", "haus"]
    rows = [(k, make(two if k % 2 else one, 60), "b" if k % 2 else "a") for k in range(80)]
    rows += [(500, None, "a"), (501, "123 ...", "a"), (502, "", None), (503, make(one, 100) + " " + make(two, 100), None), (None, make(two, 50), None)]
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (500, 501, 502))
    assert all(got[k].lang_pred == "ab"[k % 2] and got[k].languages.keys() == {"ab"[k % 2]} for k in range(80))
    assert got[None].lang_pred == "b" and set(got[503].languages) == {"a", "b"}
    unlabelled = spark.createDataFrame([(1, "text")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert langid.identify(unlabelled).head().lang_pred == "und"


def test_pipeline_stages_feed_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    out = corpus_pipeline.run(spark, sf)
    packed = [x for r in out.collect() for x in r.doc_ids]
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    assert packed and set(packed) <= kept


def test_pipeline_on_an_empty_table(spark, empty, sf, tmp_path):
    now = empty
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert now.count() == 0


@pytest.mark.parametrize("name", ["op3_decontamination", "op9_quality_rules"])
def test_sql_twins(spark, sf, name):
    import duckdb

    from silvan.llm import queries

    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = queries.queries()[name](spark, sf)
    assert Counter(map(tuple, got.collect())) == Counter(db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_quality_keeps_lines_of_other_scripts(spark):
    hindi = "\n".join("यह एक साफ वाक्य है जो पूरा होता है।" for _ in range(12))
    numbers = "\n".join(f"release v1.2 of part {k} came out with many new words inside it" for k in range(12))
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame([(1, hindi.replace("एक", "दो", 3)), (2, numbers)], "doc_id long, text string"), quality.LineRules(max_repeat_percent=100)).collect()}
    assert got == {1: True, 2: False}


def test_decontamination_in_blocks_is_the_same(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda df: Counter(map(str, df.collect()))
    assert rows(decontam.report(docs, items)) == rows(decontam.report(docs, items, block_words=700))
    whole, parts = decontam.remove_spans(docs, items), decontam.remove_spans(docs, items, block_words=700)
    assert whole.columns == docs.columns and rows(whole) == rows(parts)


def test_shortlist_of_languages_loses_nothing(spark):
    """Many languages at once: the joint drop keeps what dropping one by one, each fitted anew, would keep."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.full(400, 0.05), size=24).T + 1e-6
    model = langid.Model([f"l{k:02}" for k in range(24)], p / p.sum(axis=0))
    for trial in range(20):
        share = np.zeros(24)
        share[rng.choice(24, trial % 3 + 1, replace=False)] = 1
        counts = rng.multinomial(600, model.likelihood @ (share / share.sum())).astype(float)
        at = np.flatnonzero(counts)
        chosen, (w, fit) = np.arange(24), model.mixture(model.likelihood[at], counts[at])
        while len(chosen) > 1:
            stay = np.arange(len(chosen)) != np.argmin(w)
            new_w, new_fit = model.mixture(model.likelihood[at][:, chosen[stay]], counts[at])
            if new_fit + langid.PENALTY * np.log(counts.sum() + 1) < fit:
                break
            chosen, w, fit = chosen[stay], new_w, new_fit
        got = model.shares(model.likelihood[at], counts[at])
        assert list(got) == [model.languages[k] for k in chosen]
        assert np.allclose(list(got.values()), w, atol=0.01)


def test_language_of_odd_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    long = " ".join(r.text for r in docs.filter("lang = 'en'").limit(40).collect()) * 5
    odd = spark.createDataFrame([(10_001, long, None, 0.5, "x"), (10_002, long, "en", 0.5, "x"), (10_002, long, "en", 0.5, "x"), (10_003, "12 !?", "fr", 0.1, "y"), (None, "und", None, None, None)], "doc_id long, text string, lang string, score double, languages string")
    every = docs.withColumns({"score": F.lit(1.0), "languages": F.lit("z")}).unionByName(odd)
    got = [r for r in langid.identify(every).collect() if r.doc_id is None or r.doc_id > 10_000]
    assert sorted((str(r.doc_id), r.lang_pred) for r in got if r.doc_id) == [("10001", "en"), ("10002", "en"), ("10002", "en"), ("10003", "und")]
    assert len(got) == 5 and langid.identify(every.limit(0)).count() == 0
    # equal shares: the first language in order
    assert min({"b": 0.5, "a": 0.5}, key=lambda x: (-0.5, x)) == "a"


def test_packing_of_one_source_and_its_bins(spark):
    rows = [(k, " ".join(["w"] * (k % 7 + 1)) + f" x{k}", "only") for k in range(30)] + [(99, None, "only"), (98, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert packing.bins(docs, capacity=16).count() == 30  # no two of a source share a bin
    free = docs.withColumn("source", F.lit(None).cast("string"))
    placed = packing.pack(free, capacity=16).filter("bin_id is not null").collect()
    want = {}
    for x in sorted(placed, key=lambda x: x.start):
        want.setdefault(x.bin_id, []).append((x.doc_id, x.piece, x.start, x.n_words))
    for b in packing.bins(free, capacity=16).collect():
        mine = want.pop(b.bin_id)
        assert (b.n_words, b.doc_ids, b.pieces, b.starts) == (sum(x[3] for x in mine), [x[0] for x in mine], [x[1] for x in mine], [x[2] for x in mine])
    assert not want


def test_spooled_tables_are_swept(spark, tmp_path):
    import os

    from silvan.llm import spool

    df = spool.spool(spark.range(3), "kept")
    place = df.spooled_at.removeprefix("file://")
    assert os.path.isdir(place) and df.count() == 3
    spool.sweep(spark)
    assert not os.path.exists(place) and not spool._WRITTEN


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from silvan.llm import spool

    def fake(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: None), sparkContext=SimpleNamespace(master=master))

    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError):
            spool.shared_dir(fake(master))
    assert spool.shared_dir(fake("local[4]"))


def test_mixture_of_two_languages_is_the_likeliest():
    rng = np.random.default_rng(6)
    p = rng.dirichlet(np.full(60, 0.3), size=2).T + 1e-6
    model = langid.Model(["a", "b"], p)
    for share in (0.1, 0.5, 0.8):
        counts = rng.multinomial(800, (p @ [share, 1 - share]) / (p @ [share, 1 - share]).sum()).astype(float)
        w, fit = model.mixture(p, counts)
        grid = np.linspace(0.001, 0.999, 999)
        fits = np.log(p @ np.stack([grid, 1 - grid])).T @ counts
        assert abs(w[0] - grid[np.argmax(fits)]) < 0.01 and fit > fits.max() - 0.05
        assert list(model.shares(p, counts)) == ["a", "b"]
    alone = rng.multinomial(800, p[:, 0] / p[:, 0].sum()).astype(float)
    assert list(model.shares(p, alone)) == ["a"]
