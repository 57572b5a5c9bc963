"""Clustering, extraction and ranking against brute force, and their defined cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamtrial.llm import clustering, extraction, ranking

#: extra columns whose names the operators use themselves
VECTORS = "vec_id long, embedding array<float>, label int, chunk string, cluster string, x string"
PAGES = "page_id long, url string, html string, host string, text string, region int"
DOCS = "doc_id long, text string, n long, shard string, terms string"


# --- clustering ------------------------------------------------------------------------------------------

def plain_lloyd(vectors, k, rounds, seed):
    """Rows (id, whole numbers) by the definition, in Python's integers."""
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in vectors if i is not None)[:k]
    centroids = [list(x) for _, x in named]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in vectors:
            groups[nearest(x)[1]].append(x)
        for j, own in groups.items():
            centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    return sorted(((i is None, i, *reversed(nearest(x))) for i, x in vectors), key=str), centroids


@pytest.mark.parametrize(("dims", "columns", "chunk"), [(8, 3, 7), (64, 32, 4096)])
def test_lloyd_equals_plain_rounds(spark, monkeypatch, dims, columns, chunk):
    monkeypatch.setattr(clustering, "COLUMNS", columns)
    monkeypatch.setattr(clustering, "CHUNK", chunk)
    rng = random.Random(5)
    base = [[rng.uniform(-2, 2) for _ in range(dims)] for _ in range(60)]
    base += [base[0]] * 25 + [[0.5] * dims, [-0.5] * dims, [1e30] * dims, [-7.25e5 + i for i in range(dims)]]
    rows = [(i, x, 0, "a", "b", "c") for i, x in enumerate(base)]
    rows += [(None, base[3], None, None, None, None), (5, base[9], 1, "", "", "")]
    bad = [(200, None), (201, []), (202, base[0][:-1]), (203, [*base[0][:-1], None]), (204, [*base[0][:-1], float("nan")]), (205, [*base[0][:-1], float("-inf")]), (206, [*base[0], 0.0])]
    df = spark.createDataFrame(rows + [(i, x, 0, "", "", "") for i, x in bad], VECTORS).repartition(3)
    held = lambda v: max(-(2**27), min(2**27, math.floor(64 * float(np.float32(v)))))
    want, centroids = plain_lloyd([(r[0], tuple(held(v) for v in r[1])) for r in rows], 6, 3, 1)
    got = clustering.digest(df, dims=dims, k=6, rounds=3, seed=1).collect()
    assert sorted(((r.vec_id is None, r.vec_id, r.cluster, r.distance) for r in got), key=str) == want
    inertia = Counter()
    for _, _, c, d in want:
        inertia[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert all(r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia.values()) and r.centroid_sha256 == names[r.cluster] for r in got)


def test_lloyd_of_few_and_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert clustering.digest(empty, dims=4).collect() == []
    df = spark.createDataFrame([(1, [1.0, 2.0], 0, "", "", ""), (2, [3.0, 4.0], 0, "", "", "")], VECTORS)
    got = clustering.digest(df, dims=2, k=16).collect()
    assert len(got) == 2 and {r.cluster for r in got} == {0, 1} and all(r.distance == r.inertia == 0 for r in got)
    assert clustering.digest(df, dims=3).collect() == []


def test_distances_are_exact_for_large_numbers():
    rng = np.random.default_rng(2)
    for top in (50, 1 << 27):
        x, c = rng.integers(-top, top, (9, 32)), rng.integers(-top, top, (4, 32))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in c] for u in x]
        assert clustering.squared(x, c).tolist() == want
        assert clustering.unpacked(clustering.packed(np.array(want).ravel()), 36).tolist() == np.array(want).ravel().tolist()


# --- ranking ---------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranking(docs, items):
    """Every document against every item, from the definition."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    full = [c for _, c in counts if c]
    n_docs, total = len(full), sum(sum(c.values()) for c in full)
    df = Counter(t for c in full for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = set()
    for item, ts in wanted.items():
        found = []
        for i, c in counts:
            if i is None or not c:
                continue
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, i))
        out |= {(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(found)[:10])}
    return out


@pytest.mark.parametrize("shards", [1, 3, 1200])
def test_ranking_equals_every_document_scored(spark, monkeypatch, shards):
    monkeypatch.setattr(ranking, "WINDOW", 8)
    monkeypatch.setattr(ranking, "SHORT", 8)
    if shards == 3:
        monkeypatch.setattr(ranking, "ITEM_BYTES", 700)  # several blocks of items
    rng = random.Random(8)
    words = [f"{w}{c}" for w in ("alpha", "Élan", "x9", "b" * 200) for c in "abcdefghij"]
    prose = lambda n: " ".join(words[min(int(rng.expovariate(0.2)), 39)] for _ in range(n))
    docs = [(i, prose(rng.randint(1, 40))) for i in range(300)]
    docs += [(i + 300, docs[7][1].upper()) for i in range(40)]  # equal scores but for letters beyond ASCII
    docs += [(900, None), (901, ""), (902, "-- !"), (903, "alphaa\x00alphab"), (904, prose(20_000)), (7, docs[7][1]), (None, docs[7][1])]
    items = [(i, prose(12) + "_" + prose(2)) for i in range(25)] + [(30, ""), (31, None), (32, "nowhere"), (0, "x9a more"), (None, prose(3)), (33, words[0])]
    left = spark.createDataFrame([(*d, 1, "s", "t") for d in docs], DOCS).repartition(4)
    right = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.item_id, r.rank, r.doc_id, r.score) for r in ranking.search(left, right, None if shards == 3 else shards).collect()]
    want = plain_ranking(docs, [i for i in items if i[0] is not None])
    assert set(got) == want and len({(i, k) for i, k, *_ in got}) == len(got)


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 1, "", "")], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.search(docs.limit(0), items).collect() == []
    assert ranking.search(docs, items.limit(0)).collect() == []
    assert [(r.item_id, r.rank, r.doc_id) for r in ranking.search(docs, items).collect()] == [(1, 1, 1)]


def test_windows_are_skipped():
    """Of a long list with its best documents first, most windows stay closed."""
    docs = 40 * ranking.WINDOW
    term, doc = np.zeros(docs, np.int64), np.arange(docs)
    impact = np.where(doc < 20, 1000 - doc, 5)
    lists = ranking.Lists(np.append(term, [1] * 12), np.append(doc, np.arange(12) * 3), np.append(impact, [70] * 12), docs, 2)
    found, score, opened = ranking.best(lists, [(0, 2), (1, 3)])
    every = 2 * impact.astype(np.int64)
    every[np.arange(12) * 3] += 210
    order = np.lexsort((doc, -every))[:10]
    assert found.tolist() == order.tolist() and score.tolist() == every[order].tolist() and opened == 1


# --- extraction ------------------------------------------------------------------------------------------

def plain_matching(a, i, b, j):
    """Simple tree matching by its recurrence: the greatest number of matched nodes."""
    if a[i].label != b[j].label:
        return 0
    x, y = a[i].kids, b[j].kids
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p in range(len(x)):
        for q in range(len(y)):
            best[p + 1][q + 1] = max(best[p][q + 1], best[p + 1][q], best[p][q] + plain_matching(a, x[p], b, y[q]))
    return best[-1][-1] + 1


def random_tree(rng, deep=0):
    lines = [" " * deep + (rng.choice("abc") if deep else "page")]
    for _ in range(rng.randint(0, 4) if deep < 4 else 0):
        lines += random_tree(rng, deep + 1)
    return lines


def test_alignment_is_the_greatest_matching():
    rng = random.Random(6)
    for _ in range(120):
        a, b = (extraction.tree("\n".join(random_tree(rng))) for _ in range(2))
        pairs = extraction.aligned(a, b)
        assert len(pairs) == plain_matching(a, 0, b, 0)
        assert len(set(pairs.values())) == len(pairs) and all(a[i].label == b[j].label for i, j in pairs.items())
        assert all(pairs[a[i].parent] == b[j].parent for i, j in pairs.items() if i)
        for i in pairs:
            kids = [pairs[k] for k in a[i].kids if k in pairs]
            assert kids == sorted(kids)


def page(rng, words, i, article=True, extra=""):
    """A page of a host with all that isn't its article, and the text that should come out."""
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    paragraphs = [say(rng.randint(4, 40)) for _ in range(rng.randint(1, 6))]
    listed = [say(3) for _ in range(rng.choice([0, 0, 3]))]
    title = f"{say(3)} {i}"
    body = "".join(f"<p>{p.replace('&', '&amp;')}</p>" if k % 2 else f"<p><b>{p.replace('&', '&amp;')}<br>" for k, p in enumerate(paragraphs))
    body += "<ul>" + "".join(f"<li>{x}" for x in listed) + "</ul>" if listed else ""
    around = ("<article><h1>{}</h1>{}<div class='share'>Share it</div><p>Terms apply.</p></article>" if article else "<div class=box><div class=story><h1>{}</h1>{}<p>Terms apply.</p></div></div>").format(title, body)
    text = f"""<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><p>Site {say(2)}</p></header><nav><ul>{''.join(f'<li><a href="/{k}">{say(1)}</a>' for k in range(5))}</ul></nav><!-- <p>no</p> --><div class="ad-slot">{say(9)}</div>
<div id="cookieNotice">We use cookies {say(4)}</div>{around}<aside><p>{say(30)}</p></aside><form><label>{say(4)}</label><input value=x></form>
<section class="comments"><article><p>{say(60)}</p></article></section><footer>&copy; {say(5)}</footer>{extra}</body></html>"""
    return text, "\n".join([title, *paragraphs, *listed])


@pytest.mark.parametrize("article", [True, False])
def test_articles_of_a_host_come_out(spark, article):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéß&") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    made = [page(rng, words, i, article) for i in range(40)]
    made += [made[3]] * 60  # copies don't outvote the other pages
    rows = [(i, "http://A.example.com/x?q" if i % 2 else "https://a.example.com#y", h, "h", "t", 3) for i, (h, _) in enumerate(made)]
    got = {r.page_id: r for r in extraction.main_text(spark.createDataFrame(rows, PAGES).repartition(4)).collect()}
    for i, (_, want) in enumerate(made):
        assert got[i].text == want and got[i].n_chars == len(want) and got[i].url == rows[i][1]


def test_pages_in_defined_cases(spark):
    long = "<article>" + "<p>x</p><h2>y</h2>" * 3000 + "</article>"
    cases = [(1, None, None, ""), (2, "", "", ""), (3, "nowhere", "plain &lt;text&gt;\n of &#233; page", "plain <text> of é page"), (4, "http://b/", "<p>one<p>two", "one\ntwo"), (5, "http://b/", "<p>one<p>two", "one\ntwo"),
             (6, "http://c/", "<article><p>open", "open"), (7, "http://c/", "<nav>only</nav>", ""), (8, "http://d/", "<main><article><p>a b</p></article><article><p>c</p></article></main>", "a b\nc"), (None, "http://e/", "<p>x < y</p> <!-- end", "x < y"),
             (9, "http://f/", long, "\n".join(["x", "y"] * 3000)), (10, "http://f/", "<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"), (11, "http://g/", "<script>never ends <p>x", ""), (12, "http://g/", "</p></div><p class='x>y' title=\"a > b\">ok</p>", "ok")]
    df = spark.createDataFrame([(i, u, h, None, None, None) for i, u, h, _ in cases], PAGES)
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in extraction.main_text(df).collect())
    assert got == sorted((str(i), str(u), t, len(t)) for i, u, _, t in cases)
    assert extraction.main_text(df.limit(0)).collect() == []


def test_whole_pages_keep_repeated_paragraphs(spark):
    """A sentence that stands in some articles of a host is content; one in a slot of nearly all is template."""
    rows, want = [], {}
    for i in range(30):
        body = [f"text of page {i}", *(["a common line"] if i % 3 == 0 else []), "Sign up now"]
        rows.append((i, "http://h/", f"<title>page {i}</title><article>" + "".join(f"<p>{b}</p>" for b in body) + "</article>", None, None, None))
        want[i] = "\n".join(body[:-1])
    assert {r.page_id: r.text for r in extraction.main_text(spark.createDataFrame(rows, PAGES)).collect()} == want


def test_wrappers_count_titles_once(spark):
    rows = spark.createDataFrame([(i, "http://h/", f"<title>{min(i, 3)}</title><p>same</p><p>{i}</p>", None, None, None) for i in range(50)], PAGES)
    got = extraction.main_text(rows).where(F.col("page_id") == 9).first().text
    assert got == "same\n9"  # four voices are too few
