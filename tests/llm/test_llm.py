"""The text operators against brute force, and their defined cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from streamtrial.llm import fingerprints, jaccard, langid, linededup, lm_scoring, mixing, packing, quality, toxicity, urlfilter
from streamtrial.llm.common import span_hashes
from streamtrial.llm.linking import _block_pairs, components, sized
from streamtrial.llm.queries import tokenizer_path

#: an extra column whose name an operator might use itself
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, _key string, drop string"
R = random.Random(3)
WORDS = ["".join(R.choice("abcdeéñ") for _ in range(R.randint(1, 7))) for _ in range(300)]


def prose(n, rng=R):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, texts):
    """Rows with nulls in every column, ties and repeats."""
    rows = [(i, t, "en" if i % 3 else "fr", f"src{i % 5}", len(t) if t else None, 1, "k", None) for i, t in enumerate(texts)]
    rows += [(None, "a text without an id " * 3, None, None, None, None, None, None), (7001, None, None, None, None, None, None, None), (7002, "", "en", None, 0, 2, "", "x"), (7003, " \n\t ", None, "src1", 4, None, None, None)]
    return spark.createDataFrame(rows + rows[:1], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    long = prose(30_000)
    base = [prose(60) + "\n" + prose(40) for _ in range(12)]
    near = [base[0].replace(base[0].split()[3], "zzz", 1), base[1] + " end", base[0]]
    return table(spark, [*base, *near, long, "x", "one two", prose(9) + "\n" + base[2].split("\n")[1]]).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_langid(spark, empty):
    a, b = ["the house is on a hill and the sun " * 3, "under the old bridge the water " * 2], ["das haus steht auf dem berg und die " * 3, "unter der alten brücke das wasser " * 2]
    rows = [(i, t, "en") for i, t in enumerate(a)] + [(i + 10, t, "de") for i, t in enumerate(b)] + [(20, "the water under the house", None), (21, "DAS WASSER unter dem Haus!", None), (22, None, "en"), (23, "123 - ?", "de"), (24, "", None), (25, "the bridge " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, df).collect()}
    assert [got[i][0] for i in (0, 1, 10, 11, 20, 21, 22, 23, 24, 25)] == ["en", "en", "de", "de", "en", "de", "und", "und", "und", "en"]
    assert got[22][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(empty, df).count() == 0
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}


@pytest.mark.parametrize("block", [3, 50, langid.BLOCK])
def test_cross_parsing_equals_brute_force(monkeypatch, block):
    rng = random.Random(5)
    train = {k: "".join(rng.choice(s) for _ in range(400)).encode() for k, s in (("a", "abc "), ("b", "bcd "))}
    model = langid.build(train)
    texts = ["".join(rng.choice("abcdx ") for _ in range(n)) for n in (0, 1, 5, 60, 300, 2 * langid.BLOCK + 17)] + [train["a"].decode() * 2, "x" * 200]
    monkeypatch.setattr(langid, "BLOCK", block)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    lengths = np.array([len(t) for t in texts])
    got = langid.phrases(model, model.symbol[data], np.cumsum(lengths) - lengths, lengths)
    for row, name in enumerate(model.names):
        for i, t in enumerate(texts):
            n, p, text = 0, 0, t.encode()
            while p < len(text):
                e = p + 1
                while e <= len(text) and text[p:e] in train[name]:
                    e += 1
                p = max(p + 1, e - 1)
                n += 1
            assert got[row, i] == n


def test_names_that_clash(docs):
    named = docs.withColumns({"letter": F.lit(1), "r": F.lit(2), "_text": F.lit(3)})
    keep = ["doc_id", "letter", "r", "_text", "text"]
    model = toxicity.Chain({}, [toxicity.Link("a", -1.0, np.zeros(0), np.zeros(0))])
    for out in (langid.identify(named, named, keep), toxicity.score(named, model, keep), lm_scoring.score(named, ([], lm_scoring.start(np.zeros(lm_scoring.CLASSES))), keep)):
        assert out.columns[:5] == keep and {r[1:4] for r in out.select(*keep).collect()} == {(1, 2, 3)} and out.count() == docs.count()
    with pytest.raises(ValueError):
        langid.identify(named.withColumn("score", F.lit(1)), named, ["score"])
    with pytest.raises(ValueError):
        toxicity.score(named.withColumn("p_a", F.lit(1)), model, ["p_a"])


def logistic(x, y, penalised):
    """Class-balanced logistic regression by Newton's method; the last column is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    pull, w = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())), np.zeros(x.shape[1])
    ridge = 0.3 * np.append(np.ones(penalised), 0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (pull * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (pull * (p - y)) + ridge * w)
        w -= step * min(1, 2 / max(1e-9, np.abs(step).max()))
    return w[:-1], w[-1]


def test_chain_equals_plain_regressions():
    """Out-of-fold log odds of the first category feed the second; words are chosen by a plain chi-square."""
    rng = random.Random(3)
    texts, first, second = [], [], []
    for i in range(150):
        a, b = i % 4 == 0, i % 5 < 2  # every fold has rows with and without each
        own = ["bad"] * (a and rng.random() < 0.9) + ["worse"] * (b and rng.random() < 0.9) + ["odd"] * ((a and b) and rng.random() < 0.7)
        texts.append(" ".join([prose(6, rng), *own]))
        first.append(float(a))
        second.append(float(a and b or rng.random() < 0.05))
    labels, folds = {"one": np.array(first), "two": np.array(second)}, np.arange(150) % toxicity.FOLDS
    chain = toxicity.train(texts, labels, folds)
    words = sorted(w for w, n in Counter(w for t in texts for w in toxicity.bag(t)).items() if n >= toxicity.LEAST_TEXTS)
    assert list(chain.words) == words
    has = np.array([[w in toxicity.bag(t) for w in words] for t in texts], float)

    def fitted(rows, extra, y):
        x, y, n = has[rows], y[rows], len(rows)
        share, k = y.mean(), x.sum(0)
        chi2 = (y @ x - k * share) ** 2 / np.maximum(k * share * (1 - share), 1e-9) * n / np.maximum(n - k, 1)
        told = chi2 >= toxicity.LEAST_CHI2
        w, b = logistic(np.column_stack([x[:, told], extra[rows]]), y, int(told.sum()) + extra.shape[1])
        full = np.zeros(len(words))
        full[told] = w[: told.sum()]
        return lambda r, e: np.clip(has[r] @ full + e[r] @ w[told.sum() :] + b, -8, 8)

    every, none = np.arange(150), np.zeros((150, 0))
    odds = np.zeros(150)
    for k in range(toxicity.FOLDS):
        odds[folds == k] = fitted(every[folds != k], none, labels["one"])(every[folds == k], none)
    z1 = fitted(every, none, labels["one"])(every, none)
    z2 = fitted(every, odds[:, None], labels["two"])(every, z1[:, None])
    got = toxicity.predict(chain, texts)
    for column, z in zip(got.T, (z1, z2)):
        assert np.abs(column - 1 / (1 + np.exp(-z))).max() < 0.02


def test_toxicity(spark, empty):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, prose(40, rng) + (" idiot clown" if bad else "")))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (902, "IDIOT! clown, idiot " + prose(20_000, rng))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + labels[:2] + [(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(df, marks, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    got = {r.doc_id: r.p_toxic for r in toxicity.score(df, chain).collect()}
    assert all((got[i] >= 0.6) == (i % 4 == 0) for i in range(240))
    assert got[902] > 0.6 and got[900] < 0.5 and got[900] == got[901]
    kept = toxicity.without_category(df, chain, "toxic", 0.6)
    assert kept.columns == df.columns and kept.count() == 180 + 2
    assert toxicity.score(empty, chain).count() == 0
    none = toxicity.fit(df, marks.limit(0), {"toxic": F.col("toxic")})
    assert {round(r.p_toxic, 6) for r in toxicity.score(df, none).collect()} == {0.0}


def test_fingerprints(docs, empty):
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()), key=lambda r: (r[0], 0))
    got = {r.doc_id if r.doc_id is not None else -1: r for r in fingerprints.fingerprint_edits(docs).collect()}
    assert len(got) == len({k for k, _ in rows})
    ids = sorted(got)
    text = dict(rows)
    for k, following in zip(ids, ids[1:] + ids[:1]):
        if k == 0:  # a repeated row is followed by its copy
            continue
        m = len(text[k]) // 4
        changed = text[k][: len(text[k]) - m] + text[following][:m]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(text[k]), hashlib.sha256(changed.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(text[k]) > 200 and following != 14:
            assert r.near_edited > r.near_next
    same = defaultdict(set)
    for k in ids:
        same[text[k]].add(got[k].fingerprint)
    assert all(len(v) == 1 for v in same.values()) and got[7002].fingerprint == "" and got[0].fingerprint == got[14].fingerprint
    assert fingerprints.fingerprint_edits(empty).count() == 0
    single = docs.where("doc_id = 3")
    assert fingerprints.fingerprint_edits(single).first().near_next == 1.0


M32 = 0xFFFFFFFF


def plain_mix(v):
    v ^= v >> 16
    v = v * 0x7FEB352D & M32
    v ^= v >> 15
    v = v * 0x846CA68B & M32
    return v ^ v >> 16


def plain_level(x):
    """One level of parsing, a symbol at a time."""
    runs = [[x[0], 0]]
    for v in x:
        if v == runs[-1][0]:
            runs[-1][1] += 1
        else:
            runs.append([v, 1])
    x = [v if n == 1 else plain_mix(v ^ plain_mix(n)) for v, n in runs]
    label = x
    for _ in range(4):
        lows = [((v ^ u) & -(v ^ u)).bit_length() - 1 for v, u in zip(label, [label[0] ^ 1, *label])]
        label = [low << 1 | v >> low & 1 for v, low in zip(label, lows)]
    assert max(label) < 6
    for big in (3, 4, 5):
        label = [min({0, 1, 2} - {*label[max(i - 1, 0) : i], *label[i + 1 : i + 2]}) if v == big else v for i, v in enumerate(label)]
    around = [-1, *label, -1]
    top = [a < v > b for a, v, b in zip(around, label, around[2:])]
    start = [i == 0 or t or (around[i] > v < around[i + 2] and not any(top[max(i - 1, 0) : i + 2])) for i, (t, v) in enumerate(zip(top, label))]
    out = []
    for v, s in zip(x, start):
        if s:
            out.append([])
        out[-1].append(v)
    return [plain_mix(sum(plain_mix(v) * pow(0x9E3779B1, i % 16 + 1, 1 << 32) for i, v in enumerate(p)) & M32) for p in out]


def plain_sketch(text):
    x, names = [plain_mix(ord(c) + 1) for c in text], set()
    for level in range(1, max(fingerprints.LEVELS) + 1):
        x = plain_level(x) if x else []
        if level in fingerprints.LEVELS:
            names |= {plain_mix(v + level & M32) for v in x}
    return sorted(names)[: fingerprints.SKETCH]


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    if max(len(a), len(b)) < fingerprints.SKETCH:
        return len({*a} & {*b}) / len({*a} | {*b})
    return sum(v in a and v in b for v in sorted({*a, *b})[: fingerprints.SKETCH]) / fingerprints.SKETCH


def test_fingerprints_equal_plain_parsing(spark):
    rng = random.Random(12)
    texts = ["", "x", "ab", "aaaa", "a" * 300, prose(15, rng), prose(200, rng), "é\U0001F600" * 40, prose(3000, rng)]
    texts += [texts[6][:700] + prose(40, rng), texts[6].replace("a", "aa", 3), "".join(rng.choice("ab") for _ in range(900))]
    df = spark.createDataFrame([(i * 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(df).collect()}
    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        m = len(text) // 4
        own, changed, after = plain_sketch(text), plain_sketch(text[: len(text) - m] + following[:m]), plain_sketch(following)
        r = got[i * 7]
        assert r.fingerprint == "".join(f"{v:08x}" for v in own) and r.edited_fingerprint == "".join(f"{v:08x}" for v in changed)
        assert (r.near_edited, r.near_next) == (plain_likeness(own, changed), plain_likeness(own, after))


def test_parsing_is_locally_consistent():
    text = prose(300)
    whole = np.frombuffer((text).encode("utf-32-le"), np.uint32)
    for lead in ("", "q", "a longer lead ", "zz" * 50):
        x = np.concatenate([np.frombuffer(lead.encode("utf-32-le"), np.uint32), whole])
        names = fingerprints.next_level(fingerprints.mix32(x + np.uint32(1)), np.array([0]))[0]
        base = fingerprints.next_level(fingerprints.mix32(whole + np.uint32(1)), np.array([0]))[0]
        assert (names[-(len(base) - 12) :] == base[12:]).all()


def _repeated(words):
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    return len({i + j for places in seen.values() if len(places) > 1 for i in places for j in range(8)})


def test_quality(spark, docs, empty):
    loop = "a b c d e f g h i " * 6
    df = docs.union(table(spark, [loop + prose(200), "same\nsame\n \n \nother #*$ same", loop]).where("doc_id < 3").withColumn("doc_id", F.col("doc_id") + 500))
    trusted = spark.createDataFrame([(i,) for i in range(6)] + [(None,), (1,)], "doc_id long")
    rows = quality.judge(df, trusted).collect()
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    split = lambda t: [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
    raw, target = Counter(), Counter()

    def grams(words):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
        pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
        return [(v - (1 << 64) if v >> 63 else v) % quality.BUCKETS for v in h + pairs]

    for r in df.collect():
        raw.update(g := grams(split(r.text or "")))
        if r.doc_id in range(6):
            target.update(g)
    size = lambda c: sum(c.values()) + quality.BUCKETS
    ratio = lambda b: np.log((target[b] + 1) / size(target)) - np.log((raw[b] + 1) / size(raw))
    assert len(rows) == df.count()
    for r in rows:
        t = texts[r.doc_id]
        w = split(t)
        lines = [v for v in t.split("\n") if split(v)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), _repeated(w)), r.doc_id
        assert r.base_failed == (len(w) < 20 or 100 * _repeated(w) > 30 * len(w))
        g = grams(w)
        want = sum(map(ratio, g)) / max(1, len(g))
        assert abs(r.llr - want) < 1e-9 and r.kept == (not r.base_failed and want >= quality.THRESHOLD)
    assert quality.judge(empty, trusted).count() == 0
    assert {r.llr for r in quality.judge(docs, trusted.limit(0)).collect()} == {0.0}


def test_url_rules_and_ranks(spark):
    urls = ["http://A.example.NET/en/1?x", "http://b.example.net/de/", "https://example.com/de/2#t", "ftp://x.org/fr/", "http://x.org/en", "http://x.net", "no scheme", None, "", "http://evilexample.com/de/", "://h.com?q=/de/", "http://example.com/en/"]
    pages = spark.createDataFrame([(i, u, '<a href="http://q.com/x">q</a> <a href="/rel">r</a>' if i == 10 else None, 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(12)] == [
        ("a.example.net", "/en/1", "example.net/en/"), ("b.example.net", "/de/", "net/"), ("example.com", "/de/2", "example.com/de/"), ("x.org", "/fr/", "org/fr/"), ("x.org", "/en", None), ("x.net", "", None),
        ("", "", None), ("", "", None), ("", "", None), ("evilexample.com", "/de/", None), ("h.com", "", None), ("example.com", "/en/", None),
    ]
    assert got[0].verdict == "allow" and got[1].verdict == got[2].verdict == "block" and got[6].verdict == "allow"
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_propagation_equals_power_iteration(spark):
    rng = random.Random(2)
    edges = sorted({(f"h{rng.randrange(12)}", f"h{rng.randrange(12)}") for _ in range(40)})
    edges = [(a, b, rng.randint(1, 3)) for a, b in edges if a != b]
    seeds = [("h1", "trust", 3.0), ("h2", "trust", 1.0), ("h3", "distrust", 2.0)]
    got = {(r.host, r.kind): r.mass for r in urlfilter.propagated(spark.createDataFrame(edges, "src string, dst string, weight long"), spark.createDataFrame(seeds, "host string, kind string, mass double"), 0.7, 7).collect()}
    for kind, a, b in (("trust", 0, 1), ("distrust", 1, 0)):
        out = Counter()
        for e in edges:
            out[e[a]] += e[2]
        source = {h: 0.3 * m for h, k, m in seeds if k == kind}
        state = dict(source)
        for _ in range(7):
            new = Counter(source)
            for e in edges:
                new[e[b]] += 0.7 * state.get(e[a], 0) * e[2] / out[e[a]]
            state = dict(new)
        assert all(abs(got.get((h, kind), 0) - m) < 1e-9 for h, m in state.items())


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def mutated(s, n, rng):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        if rng.random() < 0.4 or i == len(s):
            s.insert(i, rng.choice("abcé"))
        elif rng.random() < 0.5:
            del s[i]
        else:
            s[i] = rng.choice("abcé")
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(edits):
    rng = random.Random(edits)
    a = ["".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(800)] + ["x" * 3000]
    b = [mutated(v, rng.randrange(6), rng) for v in a]
    assert linededup.within(a, b, edits).tolist() == [abs(len(x) - len(y)) <= edits and edit_distance(x, y) <= edits for x, y in zip(a[:-1], b[:-1])] + [edit_distance(a[-1][:9], b[-1][:9]) >= 0 and linededup.within(a[-1:], b[-1:], edits)[0]]


def test_line_dedup(spark, empty):
    rng = random.Random(4)
    base = [prose(12, rng) for _ in range(6)]
    # a large group of near copies and chains of them, next to clean lines
    lines = [mutated(base[0], rng.randrange(5), rng) for _ in range(60)] + [base[1]] * 30 + [mutated(base[2], 2, rng) for _ in range(10)] + base + ["short"] * 5 + ["", " "]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)]
    df = table(spark, texts).repartition(4)
    rows = sorted({(r.doc_id if r.doc_id is not None else -1, r.text) for r in df.collect() if r.text is not None})
    occ = [(d, i, v) for d, t in rows for i, v in enumerate(t.split("\n")) if len(v) >= linededup.LEAST_CHARS]
    uniq = sorted({v for *_, v in occ})
    root = {v: v for v in uniq}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(uniq):
        for b in uniq[i + 1 :]:
            if abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2:
                root[find(a)] = find(b)
    seen, drop = set(), defaultdict(list)
    for d, i, v in occ:
        (drop[d].append(i) if find(v) in seen else seen.add(find(v)))
    got = linededup.digest(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert r.dropped == (drop.get(r.doc_id, []) if r.doc_id is not None else []), r.doc_id
    out = linededup.deduplicated(df)
    assert out.columns == df.columns and out.where("doc_id = 7001 and text is null").count() == 1
    assert linededup.digest(empty).count() == 0 and linededup.deduplicated(empty).columns == df.columns


def test_short_lines_are_deduplicated(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdé ") for _ in range(n)).strip() + "x" for n in (1, 4, 9, 13, 14, 15, 16, 17, 22, 28, 29, 30, 31)]
    lines = [mutated(v, rng.randrange(4), rng) for v in base for _ in range(12)] + ["}"] * 4 + ["ok"] * 3 + ["on", "", "", " ", " "]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)]
    occ = [(d, i, v) for d, t in enumerate(texts) for i, v in enumerate(t.split("\n")) if v.strip()]
    uniq = sorted({v for *_, v in occ})
    root = {v: v for v in uniq}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    pairs = [(a, b) for i, a in enumerate(uniq) for b in uniq[i + 1 :]]
    near = [abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= min(2, min(len(a), len(b)) // 15) for a, b in pairs]
    assert linededup.linked(*zip(*pairs)).tolist() == near
    for (a, b), yes in zip(pairs, near):
        if yes:
            root[find(a)] = find(b)
    seen, drop = set(), defaultdict(list)
    for d, i, v in occ:
        (drop[d].append(i) if find(v) in seen else seen.add(find(v)))
    got = {r.doc_id: r.dropped for r in linededup.digest(table(spark, texts).where("doc_id < 7000").repartition(4)).collect()}
    assert got == {d: drop.get(d, []) for d in range(len(texts))}


def test_rows_with_equal_ids_keep_their_own_lines(spark):
    copy = "a line of more than thirty characters, the same in two documents"
    rows = [(1, f"{copy}\nfirst text"), (2, f"a UNIQUE line of more than thirty characters\nqq"), (2, f"{copy}\nsecond"), (3, f"zz\n{copy}"), (3, f"zz\n{copy}"), (None, f"{copy}\nno id")]
    got = sorted((r.doc_id or 0, r.text) for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, f"{copy}\nno id"), (1, "first text"), (2, "a UNIQUE line of more than thirty characters\nqq"), (2, "second"), (3, "zz"), (3, "zz")]


def test_many_lines_and_buckets_of_several_chunks(spark, monkeypatch):
    """One bucket that is larger than a chunk and a block, with lines of several classes; a text of 100,000 lines."""
    monkeypatch.setattr(linededup, "CHUNK", 40)
    rng = random.Random(11)
    base = ["a common head of a line, then " + "".join(rng.choice("0123456789") for _ in range(20)) for _ in range(30)]
    lines = [mutated(v, rng.randrange(3), rng) for v in base for _ in range(4)]
    rng.shuffle(lines)
    long = "\n".join(str(i) if i % 2 else "again" for i in range(100_000))
    texts = ["\n".join(lines[i : i + 7]) for i in range(0, len(lines), 7)]
    df = spark.createDataFrame([*enumerate(texts), (9999, long)], "doc_id long, text string")
    uniq = sorted(set(lines))
    root = {v: v for v in uniq}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    near = [(a, b) for i, a in enumerate(uniq) for b in uniq[i + 1 :] if abs(len(a) - len(b)) <= 2]
    for a, b in near:
        if edit_distance(a, b) <= 2:
            root[find(a)] = find(b)
    seen, drop = set(), defaultdict(list)
    for d, t in enumerate(texts):
        for i, v in enumerate(t.split("\n")):
            (drop[d].append(i) if find(v) in seen else seen.add(find(v)))
    got = {r.doc_id: r for r in linededup.digest(df).collect()}
    assert {d: got[d].dropped for d in range(len(texts))} == {d: drop.get(d, []) for d in range(len(texts))}
    assert got[9999].n_lines == 100_000 and got[9999].n_dropped == 50_000 - 1


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_jaccard_join(spark, empty, n, num, den):
    rng = random.Random(n)
    texts = []
    for size in (1, 2, 4, 9, 30, 60, 200):
        base = prose(size, rng).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(1 + size // 25)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(rng.choice([" ", "\n", " \t "]).join(w).upper() if rng.random() < 0.1 else " ".join(w))
    df = table(spark, texts).repartition(4)
    sets = {}
    for r in df.collect():
        if r.doc_id is not None:
            w = (r.text or "").encode().lower().split()
            sets[r.doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    comp = {k: k for k in sets}

    def find(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, n, num, den)[0].collect()}
    assert got == {k: (len(v), find(k)) for k, v in sets.items()}
    assert jaccard.join(empty, n, num, den)[0].count() == 0


def test_partenum_never_misses():
    rng = np.random.default_rng(1)
    for num, den in ((90, 100), (8, 10), (1, 2)):
        for size in (1, 3, 8, 20, 60, 250):
            for _ in range(30):
                a = rng.integers(0, 1 << 60, size).astype(np.uint64)
                b = a[rng.permutation(size)[: rng.integers(max(1, int(size * num / den)), size + 1)]]
                b = np.unique(np.concatenate([b, rng.integers(0, 1 << 60, rng.integers(0, 1 + size // 10)).astype(np.uint64)]))
                i = len(np.intersect1d(a, b))
                if den * i >= num * (len(a) + len(b) - i):
                    sig, own = jaccard.signatures(np.concatenate([np.unique(a), b]), np.array([len(np.unique(a)), len(b)]), num, den)
                    assert set(sig[own == 0]) & set(sig[own == 1])


def plan(df):
    other = df.sparkSession.range(1 << 22).withColumnRenamed("id", "k")
    return other.join(df.withColumnRenamed("id", "k"), "k").hint("dummy")._jdf.queryExecution().optimizedPlan().toString().replace("strategy=broadcast", "Broadcast")


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(400, 480)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    for most in (0, 200_000):  # by shuffles, and in one task
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), most).collect()}
        assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}
    assert "Broadcast" in plan(sized(spark.range(10))) and "Broadcast" not in plan(sized(spark.range(10), most=10))


def test_lm_scoring(docs, empty):
    model = lm_scoring.train(docs)
    got = {r.doc_id: r for r in lm_scoring.score(docs, model).collect()}
    assert got[7001].n_tokens == 0 and got[7001].log_prob == 0 and got[7001].mean_log_prob is None
    words, flat = model
    net = lm_scoring.unpacked(flat)
    classes = lm_scoring.Classes(words)
    for i in (0, 3, 17):
        text = docs.where(f"doc_id = {i}").first().text
        hashes, count = lm_scoring.word_hashes(pa.array([text]))
        assert count.tolist() == [len(text.split())]
        ids = [lm_scoring.BORDER] * 2 + classes(hashes).tolist() + [lm_scoring.BORDER] * 2
        total = 0.0
        for k in range(2, len(ids) - 2):
            x = np.concatenate([net["vectors"][ids[k + d]] for d in (-2, -1, 1, 2)]).astype(float)
            h = np.tanh(x @ net["hidden"] + net["shift"])
            g, w = divmod(ids[k], lm_scoring.WORDS)
            z = h @ net["out"] + net["bias"]
            total += z[g if ids[k] < lm_scoring.FREQUENT else lm_scoring.GROUPS + ids[k] - lm_scoring.FREQUENT] - np.log(np.exp(z).sum())
            if ids[k] < lm_scoring.FREQUENT:
                z = h @ net["inner"][g] + net["inner_bias"][g]
                total += z[w] - np.log(np.exp(z).sum())
        assert abs(total - got[i].log_prob) < 1e-3 * abs(total) + 1e-6
    assert lm_scoring.score(empty, lm_scoring.train(empty)).count() == 0


def one_step(net, padded, at, rate):
    """The gradient of the mean log loss of the places ``at``, token by token; inner weights by their group's own mean."""
    grad = {k: np.zeros(v.shape) for k, v in net.items()}
    size = Counter(int(padded[p]) // lm_scoring.WORDS for p in at if padded[p] < lm_scoring.FREQUENT)
    for p in at:
        t, around = int(padded[p]), [padded[p + d] for d in (-2, -1, 1, 2)]
        x = np.concatenate([net["vectors"][c] for c in around])
        h = np.tanh(x @ net["hidden"] + net["shift"])
        g, w = divmod(t, lm_scoring.WORDS)
        y = np.exp(h @ net["out"] + net["bias"])
        y /= y.sum()
        y[g if t < lm_scoring.FREQUENT else lm_scoring.GROUPS + t - lm_scoring.FREQUENT] -= 1
        back = net["out"] @ y
        grad["out"] += np.outer(h, y) / len(at)
        grad["bias"] += y / len(at)
        if t < lm_scoring.FREQUENT:
            y = np.exp(h @ net["inner"][g] + net["inner_bias"][g])
            y /= y.sum()
            y[w] -= 1
            back = back + net["inner"][g] @ y
            grad["inner"][g] += np.outer(h, y) / max(size[g], lm_scoring.LEAST_GROUP)
            grad["inner_bias"][g] += y / max(size[g], lm_scoring.LEAST_GROUP)
        back = back * (1 - h * h) / len(at)
        grad["hidden"] += np.outer(x, back)
        grad["shift"] += back
        for i, c in enumerate(around):
            grad["vectors"][c] += (net["hidden"] @ back)[i * lm_scoring.WIDTH : (i + 1) * lm_scoring.WIDTH]
    return {k: v - rate * grad[k] for k, v in net.items()}


def test_a_training_round_equals_the_plain_gradient(spark):
    texts = [prose(n, random.Random(n)) for n in (0, 3, 40, 90)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    hashes, counts = lm_scoring.word_hashes(pa.array(texts))
    frequent = sorted({int(v) for v in hashes.view(np.int64)})[:120]
    flat = lm_scoring.start(np.ones(lm_scoring.CLASSES))
    net = {k: v.astype(float) for k, v in lm_scoring.unpacked(flat).items()}
    padded, at = lm_scoring.windows(lm_scoring.Classes(frequent)(hashes), counts)
    order = np.argsort([r.text_key for r in df.orderBy("doc_id").select(F.xxhash64("text").alias("text_key")).collect()])
    hashes = np.concatenate([lm_scoring.word_hashes(pa.array([texts[i]]))[0] for i in order])  # rows come by the hash of their text
    counts = counts[order]
    padded, at = lm_scoring.windows(lm_scoring.Classes(frequent)(hashes), counts)
    masked = at[lm_scoring.masked_places(lm_scoring.shifts(hashes, counts), counts, 1)]
    assert 0 < len(masked) <= lm_scoring.STEP_ROWS
    want = one_step(net, padded, masked, 0.4)
    got = lm_scoring.unpacked(lm_scoring.trained_round(lm_scoring.dealt(lm_scoring.encoded(df, ["doc_id"], frequent), 1), flat, 0.4, 1, 1))
    for k in want:
        assert np.allclose(got[k], want[k], atol=2e-5), k


def test_lm_scores_rare_words_as_words(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(lm_scoring, "KNOWN", 100)
    counts = lm_scoring.word_counts(docs).cache()
    words, flat = lm_scoring.train(docs, counts)
    model = words, flat = words[:40], flat  # so that some words are rare, some of them known
    n = {r.word: r.n for r in counts.collect() if r.word not in set(words)}
    assert n
    size, kinds = Counter(), Counter()
    for w, k in n.items():
        size[w % lm_scoring.RARE] += k
        kinds[w % lm_scoring.RARE] += 1
    more = [(9000, "qqzzx " * 3), (9001, prose(70, random.Random(2))), (9001, "qqzzx " * 3), (9002, ""), (None, None)]
    df = spark.createDataFrame(more, "doc_id long, text string").union(docs.select("doc_id", "text"))
    plain = {(r.doc_id, r.n_tokens): r.log_prob for r in lm_scoring.score(df, model).collect()}
    got = lm_scoring.score(df, model, counts=counts).collect()
    assert len(got) == df.count()
    text = {(r.doc_id, len((r.text or "").split())): r.text or "" for r in df.collect()}
    for r in got:
        hashes = lm_scoring.word_hashes(pa.array([text[r.doc_id, r.n_tokens]]))[0].view(np.int64).tolist()
        part = 0.0
        for w in hashes:
            if w not in words:
                c = w % lm_scoring.RARE
                part += np.log((n.get(w, 0) + lm_scoring.SMOOTH) / (size[c] + lm_scoring.SMOOTH * (kinds[c] + 1)))
        assert abs(r.log_prob - plain[r.doc_id, r.n_tokens] - part) < 1e-6 * (1 + abs(part)), r
        assert r.mean_log_prob == (r.log_prob / r.n_tokens if r.n_tokens else None)
    assert lm_scoring.score(empty, lm_scoring.train(empty), counts=lm_scoring.word_counts(empty)).count() == 0


def test_every_token_is_masked_once(docs, monkeypatch):
    rng = np.random.default_rng(5)
    counts = np.array([0, 1, 3, 15, 16, 17, 0, 500])
    hashes = rng.integers(0, 1 << 60, counts.sum()).astype(np.uint64)
    turns = [lm_scoring.masked_places(lm_scoring.shifts(hashes, counts), counts, i) for i in range(lm_scoring.ROUNDS)]
    assert sorted(np.concatenate(turns)) == list(range(len(hashes)))
    used = []
    real = lm_scoring.trained_round
    monkeypatch.setattr(lm_scoring, "trained_round", lambda *a: used.append(a[-2]) or real(*a))
    lm_scoring.train(docs)
    assert used == list(range(lm_scoring.ROUNDS))


def test_training_lowers_loss():
    rng = np.random.default_rng(0)
    seq = np.tile(np.array([1, 2, 3, 4, 5], np.int32), 3000)
    padded, at = lm_scoring.windows(seq, np.array([len(seq)]))
    net = lm_scoring.unpacked(lm_scoring.start(np.bincount(seq, minlength=lm_scoring.CLASSES)))
    before = lm_scoring.log_probabilities(net, padded, at).mean()
    for _ in range(3):
        lm_scoring.learn(net, padded, rng.permutation(at), 0.5)
    assert lm_scoring.log_probabilities(net, padded, at).mean() > before + 0.8


def test_mixing_budgets_are_fair(spark):
    leaves = [("d0", "en", "a", 100), ("d0", "en", "b", 10), ("d0", "de", "c", 30), ("d1", "en", "d", 1000), ("d1", "fr", "e", 0)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, cap long")
    got = {r.source: r.budget for r in mixing.budgets(df, F.lit(400), {"domain": {"d1": 3}}).collect()}
    # d0 asks 100: en 50, de 30 (short by 20, which its sibling en takes): en 70 = b 10, a 60; d1 takes 300
    assert got == {"a": 60, "b": 10, "c": 30, "d": 300, "e": 0}
    assert {r.source: r.budget for r in mixing.budgets(df, F.lit(5000), {}).collect()} == {"a": 100, "b": 10, "c": 30, "d": 1000, "e": 0}
    assert {r.source: r.budget for r in mixing.budgets(df, F.lit(1120), {}).collect()} == {"a": 100, "b": 10, "c": 30, "d": 980, "e": 0}


def test_a_weight_of_zero_gives_nothing(spark):
    leaves = spark.createDataFrame([("d", "en", "a", 100), ("d", "en", "b", 100), ("d", "de", "c", 100)], "domain string, lang string, source string, cap long")
    got = mixing.budgets(leaves, F.lit(120), {"lang": {"de": 0}, "source": {"b": 0}}).collect()
    assert {r.source: r.budget for r in got} == {"a": 100, "b": 0, "c": 0}


def test_mixing_takes_prefixes(docs, empty):
    for fraction, epochs in ((0.5, 1), (0.7, 3), (1.0, 1)):
        took = Counter((r.doc_id, r.epoch) for r in mixing.mix(docs, fraction, epochs, 5).collect())
        rows = docs.collect()
        size = lambda t: len((t or "").split())
        total = sum(size(r.text) for r in rows)
        assert sum(size(next(r.text for r in rows if r.doc_id == d)) * n for (d, _), n in took.items()) <= total * fraction
        leaf = defaultdict(list)
        for r in rows:
            leaf[(mixing_domain(r.source), r.lang or "", r.source or "")].append(r)
        for group in leaf.values():
            order = sorted(((e, hashlib.md5(f"5|{e}|{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r.doc_id) for r in group for e in range(epochs)))
            flags = [(d, e) in took for e, _, d in order]
            assert flags == sorted(flags, reverse=True)
    # a leaf without any token has no budget; all others give everything
    assert sorted(r.doc_id for r in docs.join(mixing.mix(docs, 1.0).select("doc_id").distinct(), "doc_id", "left_anti").collect() if r.doc_id is not None) == [7002, 7003]
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs, 0.5, keep=docs.columns).columns == docs.columns


def mixing_domain(source):
    return "d" + next((c for c in source or "" if c.isdigit()), "")


def test_packing(docs, empty):
    size = 64
    cut = packing.pieces(docs, tokenizer_path(), size, with_ids=True)
    out = packing.pack(cut, size).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter((r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [0])) for r in docs.collect())
    texts = defaultdict(list)
    for r in out:
        texts[r.doc_id].append(r)
    total = 0
    for (doc, ids), n in want.items():
        own = sorted(texts[doc], key=lambda r: r.piece)
        assert len(own) == n * -(-len(ids) // size)
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * size and tuple(r.ids) == part
            import zlib

            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        total += n * len(ids)
    seqs = defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(seqs) <= -(-total // size) + 1
    assert packing.pack(packing.pieces(empty, tokenizer_path())).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_fills_well(seed):
    rng = random.Random(seed)
    counts = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    rows = packing.plan(counts)
    used = Counter()
    fill = Counter()
    for length, first, times, offset, seq in rows:
        assert first == used[length]
        used[length] += times
        for s in (seq, seq + times - 1):
            fill[s] = max(fill[s], offset + length)
    assert used == counts and max(fill.values()) <= 2048
    n = max(r[4] + r[2] for r in rows)
    assert n <= 1.01 * sum(k * v for k, v in counts.items()) / 2048 + 2


def test_blocks_of_two_chunks():
    def block(sides):
        n = len(sides)
        return {"side": np.array(sides), "id": np.arange(n), "indexed": np.ones(n, bool), "c": np.arange(n), "size": np.ones(n, np.int64), "sketch": np.zeros((n, 4), np.uint8)}

    near = lambda a, b, na, nb: (a != b).sum(-1) + 0 * (na + nb)
    pairs = lambda sides, closest=False: sorted(zip(*(v.tolist() for v in _block_pairs(block(sides), near, closest))))
    assert pairs([1, 1]) == [] and pairs([-1, -1]) == []
    assert pairs([-1, 1, 1]) == [(0, 1), (0, 2)] and pairs([0, 0, 0]) == [(0, 1), (0, 2), (1, 2)] == pairs([0, 0, 0], True)


def test_words_that_fool_polynomial_hashes(spark):
    """A Thue-Morse word and its complement collide for every base modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    hashes, counts = lm_scoring.word_hashes(pa.array([one, two, one + " x", "x"]))
    assert counts.tolist() == [1, 1, 2, 1] and hashes[0] == hashes[2] != hashes[1] and hashes[3] == hashes[4]
    df = spark.createDataFrame([(1, f"{one} x y"), (2, f"{two} x y"), (3, f"{one} x y")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join(df, n=3, num=90, den=100)[0].collect()} == {1: 1, 2: 2, 3: 1}


def test_span_hashes_depend_on_the_bytes_only():
    rng = random.Random(4)
    spans = [bytes(rng.choice(b"ab\x00\xff") for _ in range(n)) for n in [*range(1, 140), 5000] for _ in range(3)]
    data = np.frombuffer(b" ".join(spans) + b" " + b"  ".join(spans), np.uint8)
    start, at = [], 0
    for gap in (1, 2):
        for s in spans:
            start.append(at)
            at += len(s) + gap
        at += 1 - gap
    start = np.array(start)
    hashes = span_hashes(data, start, start + np.array([len(s) for s in spans] * 2)).tolist()
    assert hashes[: len(spans)] == hashes[len(spans) :]
    assert len(set(hashes)) == len(set(spans))


def test_scores_depend_on_texts_only(spark, monkeypatch):
    """Five files or fifty, any order: parts are dealt by the text, and their weights averaged in their order."""
    monkeypatch.setattr(lm_scoring, "PART_TOKENS", 400)
    monkeypatch.setattr(lm_scoring, "FAN", 3)
    rng = random.Random(21)
    df = spark.createDataFrame([(i, prose(rng.randint(0, 60), rng), "k") for i in range(200)] + [(500, None, "n"), (3, prose(2000, rng), "k")], "doc_id long, text string, n_tokens string")
    runs = [{(r.doc_id, r.n_tokens): r.log_prob for r in lm_scoring.pseudo_likelihood(df.repartition(n)).collect()} for n in (2, 13)]
    assert runs[0].keys() == runs[1].keys() and len(runs[0]) == 202
    assert all(abs(v - runs[1][k]) <= 1e-5 * (1 + abs(v)) for k, v in runs[0].items())
    model = lm_scoring.train(df)
    counts = lm_scoring.word_counts(df).cache()
    again = {(r.doc_id, r.n_tokens): r.log_prob for r in lm_scoring.score(df, model, counts=counts).collect()}
    assert all(abs(v - again[k]) <= 1e-5 * (1 + abs(v)) for k, v in runs[0].items())
    assert lm_scoring.pseudo_likelihood(df.limit(0)).count() == 0


def test_links_of_long_pages_equal_plain_counts(spark):
    """Absolute links of every kind, on a page of some hundred thousand characters; relative ones and those to the own host are no edges."""
    rng = random.Random(31)
    hosts = ["a.example.com", "B.example.com", "c.org", "x.y.c.org"]
    link = lambda: rng.choice(['<a href="https://{}/p">', "<a  HREF='//{}'>".replace("HREF", "href"), "<img src=http://user:pw@{}/i.png>", '<a href="/rel/{}">', '<a name="{}">']).format(rng.choice(hosts))
    pages = [(i, h.lower(), "".join(link() + "x" * rng.randint(0, 40) for _ in range(n))) for i, (h, n) in enumerate([*((h, 30) for h in hosts), (hosts[0], 3000), ("", 5)])]
    want = Counter()
    for _, host, html in pages:
        for m in re.finditer(r"""(?:href|src)\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s>]+)""", html):
            to = m[1].lower().rpartition("@")[2]
            if host and to != host:
                want[host, to] += 1
    for host in {h for _, h, _ in pages}:
        parts = host.split(".")
        for i in range(len(parts) - 2):
            steps = ".".join(parts[i:]), ".".join(parts[i + 1 :])
            want[steps] += 0
            want[steps[::-1]] += 0
    ups = {p for h in {h for _, h, _ in pages} for i in range(len(h.split(".")) - 2) for a, b in [(".".join(h.split(".")[i:]), ".".join(h.split(".")[i + 1 :]))] for p in ((a, b), (b, a))}
    df = spark.createDataFrame(pages, "page_id long, host string, html string").repartition(3)
    got = {(r.src, r.dst): r.weight for r in urlfilter.host_edges(df).collect()}
    assert got == {k: v + (k in ups) for k, v in want.items()}
