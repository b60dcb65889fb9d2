"""The ten operators against brute force, libraries and held-out labels on small fixtures."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from texweave.llm import best_fit_packing, bloom_lookup, compact_windows, dart_minhash, html_template, language_id, link_graph, prefix_bpe, quality_rules, training_order
from texweave.llm.graph import components
from texweave.llm.word_tokens import WordTokens, word_tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " \n\t ", "é", "a b", "x" * 3000, "# $ % & | <", "日本語 テスト\x1c\x85", "same line\nsame line\n"]


def prose(rnd, n, prefix="w"):
    return " ".join(f"{prefix}{rnd.randint(0, 10**6)}" for _ in range(n))


def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(0).cast("long"), "kept": F.lit(1), "node": F.lit("x"), "key": F.lit(2)}) if extra else df


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(1)
    return documents(spark, list(enumerate(ODD)) + [(100, prose(rnd, 30))] * 2 + [(None, "no id here")])


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def test_html(spark):
    page = """<!doctype html><html><head><title>x</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><nav>menu</nav></header>
    <div class="cookie-notice">We use cookies</div><main><article class="post"><header class="entry-header"><h1>Title &amp; <em>more</em></h1></header><p>One<br>two&nbsp;three <a href=x>link</a>.
    <p>Second &lt;b&gt; para<div class="ad">BUY</div><ul><li>a<li>b</ul><form>Search</form><aside>side</aside><section id="comments"><article class="comment">reader</article></section><!-- c --><script>"</p>"</script></article></main><footer>f</footer>"""
    assert html_template.main_text(page) == "Title & more\nOne two three link.\nSecond <b> para\na\nb"
    assert html_template.main_text(None) == html_template.main_text("") == "" and html_template.main_text("1 < 2 &am") == "1 < 2 &am"
    box = "<div><p>Call us today</p></div>"
    rows = [(i, f"http://h.org/{i}", f"<title>t{i}</title><body><div><p>page {i} text</p></div>{box}</body>") for i in range(12)] + [(50, None, None), (51, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r["page_id"]: r for r in html_template.extract(pages).collect()}
    assert all(got[i]["text"] == f"page {i} text" for i in range(12)) and got[50]["text"] == got[51]["text"] == "" and got[3]["n_chars"] == 11
    copies = spark.createDataFrame([(i, "http://h.org/", f"<title>t</title><article><p>same story</p>{box}</article>") for i in range(30)], "page_id long, url string, html string")
    assert {r["text"] for r in html_template.extract(copies).collect()} == {"same story\nCall us today"}
    assert html_template.extract(pages.limit(0)).count() == 0


def test_html_of_broken_and_long_pages():
    assert html_template.main_text('<article><p>one <a href="x"">two</a> three<div class="form-example">f</div><div class="social-history">s</div><div class="ad">A</div>') == "one two three\nf\ns"
    assert html_template.main_text("a <b title='never ends> b") == "a" and html_template.main_text("a <!-- b") == "a" and html_template.main_text("a < b </> c") == "a < b c"
    for broken in ("<a " * 300_000, "<b>" * 100_000 + "</i>" * 100_000, "</script " * 100_000, '<a "' * 200_000, "<p>" + "<b>" * 60_000 + "<div></div>" * 60_000):
        began = time.process_time()
        html_template.main_text(broken)
        assert time.process_time() - began < 5


def test_templates_against_counting(spark, monkeypatch):
    """Subtrees that recur, counted page by page; the text follows from them without any label."""
    rnd = random.Random(16)
    notice, menu = "<div id=n><p>We value your visit</p></div>", "<ul><li>Home</li><li>News</li></ul>"
    page = lambda i: f"<body>{menu}<div>{''.join(f'<p>{prose(rnd, 9)}</p>' for _ in range(3))}<table><tr><td>Yes</td></tr></table></div>{notice}<div class=menu>{i}</div></body>"
    rows = [(i, f"http://{'ab'[i % 2]}.org/{i}", page(i)) for i in range(40)] + [(100 + i, "http://a.org/c", "<p>one story</p><div>box</div>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen, texts = {}, {}
    for _, url, source in rows:
        host = url.split("/")[2]
        article, found = html_template.subtrees(source)
        texts.setdefault(host, set()).add(article)
        for digest, dear in found.items():
            seen.setdefault((host, digest), [set(), False])[0].add(article)
            seen[host, digest][1] |= dear
    want = {k for k, (on, dear) in seen.items() if len(on) >= 5 and len(on) >= (0.5 if dear else 0.02) * len(texts[k[0]])}
    assert {(r["host"], r["digest"]) for r in html_template.templates(pages).collect()} == want and len(want) >= 8
    root = html_template.parse(rows[0][2])
    html_template._digest(root)
    own = frozenset(d for h, d in want if h == "a.org")
    text = html_template.main_text(rows[0][2], own)
    assert "value" not in text and "News" not in text and len(text.split("\n")) == 3
    for empty in ("LABELS", "REPLIES", "ROLES", "HEADS"):
        monkeypatch.setattr(html_template, empty, frozenset())
    assert html_template.main_text(rows[0][2], own) == text + "\n0"


def test_compact_windows_cover_every_stretch():
    rng = np.random.default_rng(0)
    for n, width in ((0, 5), (4, 5), (5, 5), (60, 7), (61, 20)):
        values = rng.permutation(n).astype(np.uint64) << np.uint64(20)
        windows = compact_windows.compact_windows(values, width)
        starts = [(max(l, c - width + 1), c, min(c, r - width + 1)) for l, c, r in windows]
        assert sorted(starts) == list(zip(*(x.tolist() for x in compact_windows._starts(values, width))))
        for i in range(n):
            for j in range(i + width - 1, n):
                c = i + int(values[i : j + 1].argmin())
                assert sum(l <= i <= m <= j <= r for l, m, r in windows) == 1 and any(m == c and l <= i and j <= r for l, m, r in windows)


def test_repeated_passages(spark, odd, empty):
    rnd = random.Random(2)
    passage, loop = prose(rnd, 55), "tick tock " * 60
    near = passage.split()
    near[25] = "changed"
    rows = [(1, prose(rnd, 40) + " " + passage + " " + prose(rnd, 30)), (2, prose(rnd, 80)), (3, passage), (4, prose(rnd, 70) + " " + passage), (5, " ".join(near) + " " + prose(rnd, 9)), (6, passage[:200]), (7, loop + prose(rnd, 60)), (8, prose(rnd, 60) + " " + loop)]
    docs = documents(spark, rows)
    found = {r["doc_id"]: {(s["start"], s["end"]) for s in r["spans"]} for r in compact_windows.spans(compact_windows.passages(docs)).collect()}
    assert found == {3: {(0, 55)}, 4: {(70, 125)}, 5: {(0, 55)}, 8: {(60, 180)}}
    left = {r["doc_id"]: r for r in compact_windows.remove(docs).collect()}
    assert sorted(left) == [1, 2, 4, 5, 6, 7, 8] and left[4]["text"].split() == rows[3][1].split()[:70] and left[1]["text"] == rows[0][1]
    assert left[4]["n_chars"] == len(left[4]["text"]) and compact_windows.remove(docs).columns == docs.columns
    assert compact_windows.passages(odd).count() == 0 and compact_windows.remove(odd).count() == odd.count()
    assert compact_windows.passages(empty).count() == 0


def test_repeats_of_middle_texts(spark):
    """A part of the passage in the first and the last text hides no repeat between the others."""
    rnd = random.Random(12)
    passages = [prose(rnd, 50).split() for _ in range(12)]
    rows = []
    for n, passage in enumerate(passages):
        for k in range(6):
            part = passage[5:45] if k in (0, 5) else passage
            rows.append((10 * n + k, " ".join([prose(rnd, 30), *part, prose(rnd, 30)])))
    found = {r["doc_id"]: {(s["start"], s["end"]) for s in r["spans"]} for r in compact_windows.spans(compact_windows.passages(documents(spark, rows))).collect()}
    tied = sum(any(a <= 30 and b >= 80 for a, b in found.get(10 * n + k, ())) for n in range(12) for k in (2, 3, 4))
    assert tied == 36


def test_one_id_with_two_texts(spark):
    """Passages belong to a text, not to an id: another text of the id loses nothing."""
    rnd = random.Random(13)
    passage = prose(rnd, 60)
    rows = []
    for n in range(6):
        rows += [(2 * n, prose(rnd, 70)), (2 * n + 1, prose(rnd, 5) + " " + passage), (2 * n + 1, prose(rnd, 90)), (2 * n + 1, prose(rnd, 3))]
    left = Counter((r["doc_id"], r["text"]) for r in compact_windows.remove(documents(spark, rows)).collect())
    want = Counter((i, " ".join(x.split()[:5]) + " " if passage in x and i > 1 else x) for i, x in rows)
    assert left == want


def test_repeats_hidden_by_a_common_line(spark):
    """A line that all texts share makes no pairs of its own and hides no longer passage around it."""
    rnd = random.Random(14)
    line, passage = prose(rnd, 30), prose(rnd, 30)
    rows = [(i, f"{prose(rnd, 30)} {line} {prose(rnd, 40)}") for i in range(120)]
    rows += [(200 + i, f"{prose(rnd, 30)} {line} {passage} {prose(rnd, 20)}") for i in range(3)] + [(300, f"{prose(rnd, 9)} {line}")]
    found = [(r["doc_id"], r["src_id"], r["start_word"], r["end_word"]) for r in compact_windows.passages(documents(spark, rows)).collect()]
    assert {x[0] for x in found} == {201, 202} and all(x[2:] == (30, 90) for x in found)


def test_repeats_behind_chains_of_partial_holders(spark):
    """Partial holders before and after the holders of a passage, which together have every two places of it, hide none of these."""
    rnd = random.Random(16)
    rows = []
    for n in range(8):
        passage = prose(rnd, 50).split()
        parts = [passage[:44], passage[6:], [*passage[:20], "x", *passage[21:30], "y", *passage[31:]]]
        for k, part in enumerate([*parts, *[passage] * 3, *parts]):
            rows.append((10 * n + k, " ".join([prose(rnd, 30), *part, prose(rnd, 30)])))
    found = {r["doc_id"]: {(s["start"], s["end"]) for s in r["spans"]} for r in compact_windows.spans(compact_windows.passages(documents(spark, rows))).collect()}
    assert all(any(a <= 30 and b >= 80 for a, b in found.get(10 * n + k, ())) for n in range(8) for k in (4, 5))


@pytest.mark.parametrize("few", [2, 32])
def test_families_of_edited_passages_leave_no_word_out(spark, monkeypatch, few):
    """What any two texts of a family share as a repeat is covered in the later one; by keys, and by comparing all."""
    monkeypatch.setattr(compact_windows, "FEW", few)
    rnd = random.Random(17)
    rows = []
    for n in range(3):
        passage = prose(rnd, 110).split()
        for k in range(45):
            part = list(passage)
            for _ in range(rnd.randint(2, 6)):
                at = rnd.randrange(len(part))
                part[at : at + rnd.choice((0, 1, 1, 1, 4))] = prose(rnd, rnd.choice((0, 1, 1, 1, 6))).split()
            rows.append((100 * n + k, " ".join([prose(rnd, rnd.randint(0, 9)), *part, prose(rnd, 9)])))
    hashes = compact_windows.WordHashes()
    tokens = {i: (compact_windows.tokens(t.encode().split(), hashes) >> np.uint64(32)).astype("<u4") for i, t in rows}
    want = {i: set() for i in tokens}
    for i in tokens:
        for j in range(i // 100 * 100, i):
            earlier = compact_windows.Ranked(tokens[j])
            want[i].update(*(range(*r) for r in compact_windows.repeated(tokens[i], earlier, compact_windows.diagonals(tokens[i], earlier))))
    got = {i: set() for i in tokens}
    for r in compact_windows.passages(documents(spark, rows)).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert got == want and sum(map(len, want.values())) > 3000


def test_windows_of_many_texts_are_made_together(monkeypatch):
    """A batch of short texts takes few steps over all of them, not some for each, and each text has the windows that it has alone."""
    rnd = random.Random(18)
    texts = [prose(rnd, rnd.choice((0, 3, 49, 50, 51, 60, 120))) for _ in range(400)] + ["", " ", prose(rnd, 30000), "a\x0bb\x1cc \t\r\n\x0cd\u00a0e " + prose(rnd, 50), "tick tock " * 60]
    raws = [t.encode() for t in texts]
    steps = []
    monkeypatch.setattr(compact_windows, "mix", lambda x, mix=compact_windows.mix: steps.append(len(x)) or mix(x))

    def made(some):
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([x for _, x in some], pa.binary())], names=["id", "raw"])
        found = (r for b in compact_windows._windows.__wrapped__(iter([batch])) for r in b.to_pylist())
        unpacked = lambda x: np.frombuffer(x, "<i8").tolist()
        return {r["id"]: (sorted(zip(unpacked(r["keys"]), unpacked(r["places"]))), sorted(unpacked(r["short"])), r["digest"]) for r in found}

    together = made(list(enumerate(raws)))
    assert len(steps) < 100
    assert together == {i: x for k in enumerate(raws) for i, x in made([k]).items()}
    hashes = compact_windows.WordHashes()
    for i, raw in enumerate(raws):
        values = compact_windows.tokens(raw.split(), hashes)
        assert (i in together) == (len(values) >= compact_windows.WIDTH)
        if 0 < len(values) < 200 and i in together:
            centers = sorted(c for seed in compact_windows.SEEDS for _, c, _ in compact_windows.compact_windows(compact_windows.mix(values ^ seed), compact_windows.WIDTH))
            assert sorted(place >> 12 for _, place in together[i][0]) == centers


def test_repeats_of_tokens_that_occur_often():
    """Matches near a diagonal are all places within DRIFT, also where the earlier text has a token many times."""
    rnd = np.random.default_rng(19)
    found = 0
    for trial in range(60):
        kinds = (30, 300, 10**6)[trial % 3]
        earlier = rnd.integers(0, kinds, 150).astype("<u4")
        own = np.concatenate([rnd.integers(0, kinds, 20), np.delete(earlier[30:120], rnd.integers(0, 90, 2)), rnd.integers(0, kinds, 20)]).astype("<u4")
        ranked = compact_windows.Ranked(earlier)
        want, last = set(), None
        for shift in sorted(compact_windows.diagonals(own, ranked)):
            if last is not None and shift - last <= compact_windows.DRIFT // 2:
                continue
            last = shift
            match = [any(own[i] == earlier[j] for j in range(max(0, i + shift - compact_windows.DRIFT), min(len(earlier), i + shift + compact_windows.DRIFT + 1))) for i in range(len(own))]
            often = [x for x in earlier.tolist() if earlier.tolist().count(x) > 1]
            if len(often) >= compact_windows.WIDTH:
                match = [m or x in often for m, x in zip(match, own.tolist())]
            good = [a for a in range(len(own) - compact_windows.WIDTH + 1) if sum(match[a : a + compact_windows.WIDTH]) >= compact_windows.NEED]
            for a in good:
                inside = [i for i in range(a, a + compact_windows.WIDTH) if match[i]]
                want.update(range(inside[0], inside[-1] + compact_windows.SIZE))
        got = {w for a, b in compact_windows.repeated(own, ranked, compact_windows.diagonals(own, ranked)) for w in range(a, b)}
        assert want <= got and (kinds < 10**6 or got == want)
        found += bool(want)
    assert found > 40


def test_recall_of_passages(spark):
    """Edited passages of over 50 words, against all pairs of texts compared along their diagonals."""
    rnd = random.Random(15)
    rows = []
    for n in range(60):
        passage = prose(rnd, rnd.randint(52, 90)).split()
        rows.append((2 * n, " ".join([prose(rnd, rnd.randint(0, 40)), *passage, prose(rnd, 20)])))
        passage[rnd.randrange(len(passage))] = "edit"
        rows.append((1000 + 2 * n, " ".join([prose(rnd, rnd.randint(0, 40)), *passage, prose(rnd, 20)])))
    hashes, want = compact_windows.WordHashes(), set()
    tokens = {i: (compact_windows.tokens(t.encode().split(), hashes) >> np.uint64(32)).astype("<u4") for i, t in rows}
    for i in tokens:
        for j in tokens:
            if j < i:
                earlier = compact_windows.Ranked(tokens[j])
                want |= {(i, j, *r) for r in compact_windows.repeated(tokens[i], earlier, compact_windows.diagonals(tokens[i], earlier))}
    got = {(r["doc_id"], r["src_id"], r["start_word"], r["end_word"]) for r in compact_windows.passages(documents(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 50


def test_url_rules_and_links(spark):
    urls = ["https://a.EXAMPLE.com/en/70?x", "http://com/en/", "http://x.com/fr", "http://example.net/de/8#q", "http://b.net/de/1", "nothing", None, "http://acom/en/", "http://y.org/es/z", "http://h.com?/en/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("rule", F.lit(1))
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in link_graph.judge(pages).orderBy("page_id").collect()]
    assert got[0] == ("a.example.com", "/en/70", "example.com/en/7", "allow") and got[1] == ("com", "/en/", "com/en/", "block") and got[2][2:] == (None, "allow")
    assert got[3] == ("example.net", "/de/8", "example.net/de/8", "block") and got[4][2:] == ("net/de/", "allow") and got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2] is None and got[8][3] == "block" and got[9] == ("h.com", "", None, "allow")
    assert link_graph.judge(pages.limit(0)).count() == 0
    edges = [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("a", "c", 3)]
    scores = {r["host"]: r["score"] for r in link_graph.rank(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([("a", 1.0)], "host string, weight double"), damping=0.2, tolerance=1e-3).collect()}
    m = np.array([[0, 0, 1], [0.25, 0, 0], [0.75, 1, 0]])
    x = np.linalg.solve(np.eye(3) - 0.2 * m, np.array([0.8, 0, 0]))
    assert [scores[k] for k in "abc"] == pytest.approx(x.tolist(), abs=2e-3)
    link = lambda *hosts: "".join(f'<a class=x href="http://{h}/p">l</a>' for h in hosts)
    web = [(1, "http://bad.com/en/1", ""), (2, "http://farm.info/1", link("bad.com")), (3, "http://good.info/1", link("fine.info")), (4, "http://fine.info/1", "")]
    judged = {r["page_id"]: r["verdict"] for r in link_graph.judge(spark.createDataFrame(web, "page_id long, url string, html string")).collect()}
    assert judged == {1: "block", 2: "block", 3: "allow", 4: "allow"}


@given(st.integers(1, 3000), st.integers(0, 2**63))
@settings(max_examples=40, deadline=None)
def test_permutation(n, key):
    slots = training_order.permute(np.arange(n), n, key)
    assert sorted(slots.tolist()) == list(range(n)) and (training_order.trace(slots, n, key) == np.arange(n)).all()


def test_training_order(spark, odd, empty, tmp_path):
    rnd = random.Random(3)
    docs = documents(spark, [(i, prose(rnd, rnd.randint(0, 700))) for i in range(40)]).union(odd)
    path = f"file://{tmp_path}/shards"
    n = training_order.materialise(docs, path, WORDS, shard_slots=32)
    rows = training_order.read(spark, path).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(n)) and all(r["shard"] == r["slot"] // 32 and r["offset"] == r["slot"] % 32 * training_order.RECORD.itemsize for r in rows)
    want = Counter()
    for r in docs.collect():
        ids = [*word_tokens(WORDS).library_ids(r["text"] or "").tolist(), 1]
        want.update((r["doc_id"], k, tuple(ids[at : at + 512])) for k, at in enumerate(range(0, len(ids), 512)))
    assert Counter((r["doc_id"], r["piece"], tuple(r["ids"])) for r in rows) == want
    assert [r["slot"] for r in training_order.read(spark, path, 50).orderBy("slot").collect()] == list(range(50, n))
    assert training_order.order(empty, WORDS).count() == 0


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd, empty):
    rnd = random.Random(4)
    words = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(3, 9))) for _ in range(n))
    part = words(9)
    texts = [words(60), part + " x " + part + " " + part, "a b c d e f g h " * 4, "WORD! " * 40, "w# " * 30, "line one two\n" * 9, *ODD]
    got = {r["doc_id"]: r for r in quality_rules.judge(documents(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(t)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    assert got[0]["kept"] and not any(got[i]["kept"] for i in range(2, len(texts)))
    assert quality_rules.judge(odd).count() == odd.count() and quality_rules.judge(empty).count() == 0
    kept = quality_rules.keep(documents(spark, list(enumerate(texts))))
    assert [r["doc_id"] for r in kept.collect()] == [i for i in got if got[i]["kept"]] and "n_chars" in kept.columns
    import pandas as pd

    rates = pd.DataFrame([("repeats", 10, 5, 1.0), ("symbols", 10, 1, 0.001)], columns=["rule", "n", "hits", "seconds"])
    assert [r.name for r in quality_rules.order(rates)][:2] == ["symbols", "repeats"]


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    for weighted in (False, True):
        gaps = []
        for _ in range(40):
            x = rng.integers(0, 2**63, 120).astype(np.uint64)
            if weighted:
                a, b = rng.random(120) * 6, rng.random(120) * 6
                true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
                same = dart_minhash.signature(x, a) == dart_minhash.signature(x, b)
            else:
                true, same = 80 / 120, dart_minhash.signature(x[:100]) == dart_minhash.signature(x[20:])
            gaps.append(same.mean() - true)
        assert abs(np.mean(gaps)) < 0.03
    assert not dart_minhash.signature(np.empty(0, np.uint64)).any()


def test_crowded_buckets_leave_no_document_apart(spark, monkeypatch):
    """Hundreds of texts in one bucket, of which only scattered pairs are alike: classes as from all pairs."""
    rnd = random.Random(8)
    monkeypatch.setattr(dart_minhash, "BLOCK", 7)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for n in range(150):  # copies that differ from each other by more than the limit; one in three has a twin
        text = list(base)
        for k in rnd.sample(range(100), 5):
            text[k] = f"e{n}_{k}"
        rows.append((2 * n, " ".join(text)))
        if n % 3 == 0:
            text[rnd.randrange(100)] = f"t{n}"
            rows.append((2 * n + 1, " ".join(text)))
    docs = documents(spark, rows)
    sets = {i: dart_minhash.runs(t.encode(), dart_minhash.WordHashes())[0] for i, t in rows}
    named = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("node"))
    # One bucket for all: signatures have nothing to say, so that pairs are left to the code under test.
    sketch = {i: dart_minhash.signature(x).astype("<u2").tobytes() for i, x in sets.items()}
    node = {r["doc_id"]: r["node"] for r in named.collect()}
    nodes = spark.createDataFrame([(node[i], i, [1], bytearray(sketch[i])) for i in sets], "node string, copy_of long, keys array<long>, sketch binary")
    got = {r["node"]: r["class"] for r in dart_minhash.linked(nodes, named).collect()}
    group = {i: i for i in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True)) if a < b else 0
            if both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                group[root(b)] = root(a)
    want, told = {}, {}
    for i in sets:
        want.setdefault(root(i), set()).add(i)
        told.setdefault(got.get(node[i], node[i]), set()).add(i)
    assert sorted(map(sorted, told.values())) == sorted(map(sorted, want.values())) and 100 < len(want) < 200


def test_near_duplicates(spark, odd, empty):
    rnd = random.Random(6)
    rows, n = [], 0
    for _ in range(25):
        base = prose(rnd, rnd.randint(60, 200)).split()
        for edits in (0, 0, 1, 2, 4, 9):
            text = list(base)
            for k in rnd.sample(range(len(text)), edits):
                text[k] = f"edit{rnd.random()}"
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(900, "one two"), (901, "one two"), (902, ""), (903, None), (904, "one")]
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    group = {i: i for i, _ in rows}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (a, _) in enumerate(rows):
        for b, _ in rows[:i]:
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    docs = documents(spark, rows)
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.classes(docs).collect()}
    assert got == {i: root(i) for i, _ in rows}
    kept = dart_minhash.keep(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values())) and kept.columns == docs.columns
    assert dart_minhash.classes(odd).count() == odd.count() and dart_minhash.classes(empty).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["class"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


def test_fingerprints(spark, odd, empty):
    rnd = random.Random(7)
    texts = [". ".join(prose(rnd, rnd.randint(1, 8)) for _ in range(rnd.randint(1, 90))) for _ in range(30)] + ["", "same. text.", "same. text.", None, "é" * 7]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in bloom_lookup.compare(documents(spark, rows)).collect()}
    parts = lambda t: {x for x in re.split(r"[.!?\n]+\s*", t) if x}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, text in rows:
        text, after = text or "", texts[i - 1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(alike(parts(text), parts(edited))) and r["near_next"] == pytest.approx(alike(parts(text), parts(after)))
    assert got[31]["fingerprint"] == got[32]["fingerprint"] != got[0]["fingerprint"]
    assert bloom_lookup.compare(odd).count() == odd.count() and bloom_lookup.compare(empty).count() == 0
    plan = bloom_lookup.compare(documents(spark, rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_next_document_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(bloom_lookup, "BLOCK", 7)
    ids = sorted({*range(0, 90), *range(1000, 1040), 10**12, -5})
    got = {r["doc_id"]: r["next_text"] for r in bloom_lookup.with_next(documents(spark, [(i, str(i)) for i in ids])).collect()}
    assert got == {x: str(ids[k - 1]) for k, x in enumerate(ids)}


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[k] -= items[i]
            go(i + 1, rooms)
            rooms[k] += items[i]
        go(i + 1, rooms + [capacity - items[i]])

    go(0, [])
    return best[0]


@given(st.integers(5, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=8))))
@settings(max_examples=150, deadline=None)
def test_reduction_keeps_the_optimum(case):
    capacity, items = case
    plan = best_fit_packing.Plan(capacity)
    left = list(Counter(best_fit_packing.reduce_dominated(dict(Counter(items)), plan)).elements())
    assert plan.bins + (fewest(left, capacity) if left else 0) == fewest(items, capacity)
    full = best_fit_packing.make_plan(dict(Counter(items)), capacity)
    placed = Counter()
    for runs, n in full.patterns:
        assert sum(s * c for s, c in runs) <= capacity
        for s, c in runs:
            placed[s] += c * n
    assert placed == Counter(items)


def test_plan_of_many_dominated_pairs_is_short():
    counts = {3000: 200_000, 1000: 250_000, 2900: 90_000, 1100: 60_000}
    plan = best_fit_packing.make_plan(counts)
    assert len(plan.patterns) < 20
    placed = Counter()
    for runs, n in plan.patterns:
        assert sum(s * c for s, c in runs) <= plan.capacity
        placed.update({s: c * n for s, c in runs})
    # No two large ones share a bin and each has room for one small one; the other 20,000 go by fours.
    assert placed == counts and plan.bins == 290_000 + 20_000 // 4


def test_packing(spark, odd, empty):
    rnd = random.Random(8)
    docs = documents(spark, [(i, prose(rnd, rnd.choice([1, 5, 40, 300, 2500]))) for i in range(60)]).union(odd)
    rows = best_fit_packing.pack(docs, WORDS).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*word_tokens(WORDS).library_ids(r["text"] or ""), 1], "<u4")
        want.update((r["doc_id"], k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096
    assert best_fit_packing.pack(empty, WORDS).count() == 0
    plain = docs.filter("doc_id < 60 and n_chars = 0").dropDuplicates(["doc_id"])
    whole = best_fit_packing.sequences(plain, best_fit_packing.pack(plain, WORDS), WORDS).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in best_fit_packing.pack(plain, WORDS).collect())


def test_language_id(spark, odd, empty):
    rnd = random.Random(9)
    stems = {"xx": ["ka", "ro", "mi"], "yy": ["ße", "ün", "och"], "zz": ["lle", "eau", "oi"]}
    rows = [(i, " ".join("".join(rnd.choices(stems[lang], k=3)) for _ in range(rnd.randint(3, 60))), lang) for i, lang in enumerate(rnd.choices(list(stems), k=240))]
    rows += [(900, None, "xx"), (901, "12 !?", "yy"), (902, "karomi", None)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert len(held) > 30 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] >= 900} == {900: "und", 901: "und", 902: "xx"}
    assert language_id.identify(odd).count() == odd.count() and language_id.identify(empty).count() == 0
    kept = language_id.keep(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, _, _ in rows if i < 900}


@pytest.fixture(scope="module")
def codec():
    return prefix_bpe.Codec(prefix_bpe.load_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.table.ranks, special_tokens={})


def test_prefix_bpe(codec, reference):
    rnd = random.Random(10)
    letters = "abcdefghijklmnopqrstuvwxyzEéß 12'\n\t\x1c\x85　.,!?世界😀 the  ing"
    for _ in range(1500):
        text = "".join(rnd.choices(letters, k=rnd.randint(0, 40)))
        ids = reference.encode_ordinary(text)
        assert codec.encode(text) == ids and codec.both(text) == (" ".join(map(str, ids)), text.encode())
    piece = bytes(rnd.choices(b"abanerting", k=600))
    kept = prefix_bpe.PrefixEncoder(codec.table, piece[:300])
    kept.append(piece[300:])
    kept.replace(200, 205, b"tion")
    for size in (1, 150, 203, 400, len(kept.text)):
        assert kept.ids(size) == reference._core_bpe.encode_single_piece(kept.text[:size])


def test_prefix_bpe_query(spark, odd, empty, reference):
    for r, d in zip(prefix_bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN).collect(), odd.collect()):
        ids = reference.encode_ordinary(d["text"] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
    assert prefix_bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_word_tokens_equal_library():
    tokens, rnd = WordTokens(WORDS), random.Random(11)
    letters = "".join(map(chr, range(256))) + "abcdefghijklmnop     's're日"
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(3000)] + ["a" * 500, "x <|endoftext|> y", ""]
    for text, ids in zip(texts, tokens.all_ids(texts)):
        assert ids.tolist() == tokens.library_ids(text).tolist()
