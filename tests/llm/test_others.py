import hashlib
import random
import re
import time

import numpy as np
import pytest

from embervane.llm import chat, decontaminate, fingerprints, html_extract, toxicity, urlfilter
from embervane.llm.common import local_rows


# ---- decontamination


def test_leaks(spark, docs_of, prose):
    items = [(i, prose(f"item{i}", 30)) for i in range(8)] + [(8, items0 := prose("item0x", 24)), (9, items0), (10, ""), (11, None), (12, "three little words")]
    w0 = items[0][1].split(" ")
    long = prose("item50", 400).split(" ")
    items.append((13, " ".join(long)))
    changed = long[:]
    changed[200] = "other"
    rows = [
        (1, f"{prose(1, 100)} {items[0][1].upper()} {prose(2, 50)}"), (2, f"{prose(3, 30)} {', '.join(items[1][1].split(' '))}!"), (3, prose(4, 200)), (4, None), (5, ""),
        (6, f"x {items[8][1]} y"), (7, " ".join(w0[:20])), (8, f"a Three-Little words b"), (9, " ".join(["pre", *changed, "post"])), (9, " ".join(["pre", *changed, "post"])),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(rows), bench).collect())
    assert got == [(1, 0), (2, 1), (6, 8), (6, 9), (8, 12), (9, 13)]
    one = [r for r in decontaminate.leaks(docs_of(rows), bench).collect() if r.doc_id == 1][0]
    assert (one.start, one.end, one.similarity) == (100, 130, 1.0)
    assert decontaminate.leaks(docs_of(rows), bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs_of(rows).limit(0), bench).count() == 0


# ---- fingerprints


def test_likeness_estimates_jaccard(prose):
    import pyarrow as pa

    errors = []
    for seed in range(30):
        w = prose(seed, 400).split(" ")
        v = w[: 400 - 10 * seed] + prose(seed + 1000, 10 * seed).split(" ")
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v)]
        a, b = fingerprints.fingerprint_column(pa.array([" ".join(w), " ".join(v)]))
        errors.append(fingerprints.likeness(a, b) - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert abs(sum(errors) / 30) < 0.03 and max(map(abs, errors)) < 0.15


def test_sparse_sets_are_densified_alike(prose):
    import pyarrow as pa

    a, b, c, e, f = fingerprints.fingerprint_column(pa.array(["one two three", "one two  three", "four", "", None]))
    assert a == b and e == f and fingerprints.likeness(a, c) < 0.2 and fingerprints.likeness(e, f) == 1 and fingerprints.likeness(a, e) == 0


def test_next_document(spark, docs_of):
    r = random.Random(2)
    rows = [(i * 3, "".join(r.choice("aé😀 b") for _ in range(r.randrange(0, 40)))) for i in range(101)] + [(1000, None)]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    got = {x.doc_id: x for x in fingerprints.with_next(docs_of(rows)).mapInArrow(fingerprints._compare, schema).collect()}
    assert len(got) == len(rows)
    rows = [(i, t or "") for i, t in rows]
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        h = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest() and got[i].n_chars == len(t)
    assert fingerprints.with_next(docs_of(rows).limit(0)).count() == 0
    assert fingerprints.with_next(docs_of([(7, "only")])).mapInArrow(fingerprints._compare, schema).first().near_next == 1.0


# ---- toxicity


def test_toxicity_learns_words_and_beginnings(spark, docs_of):
    r = random.Random(4)
    clean = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(700):
        w = [r.choice(clean) for _ in range(r.randrange(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(("Grumblefig,", "snortle", f"vexo{r.choice('abcdefgh')}{r.randrange(99)}"))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(701, None), (702, ""), (703, "vexoz17 unseen ending, vexok23 é grumblefig"), (704, "word1 " * 4000)]
    docs, lab = docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    field = toxicity.train(docs, lab)
    got = {x.doc_id: x for x in toxicity.score_documents(docs.drop("toxic_spans"), field).collect()}
    held = {x.doc_id for x in lab.where(toxicity.held_out(lab.doc_id)).collect()}
    assert len(held) > 100 and len(got) == len(rows)
    right = sum((got[i].score >= 0.5) == bool(t) for i, t in labels if i in held)
    assert right >= 0.97 * len(held)
    assert got[701].score == got[702].score < 0.1 and got[704].score < 0.1 and got[703].score > 0.5
    assert [rows[702][1][s.start : s.end].lower()[:4] for s in got[703].toxic_spans] == ["vexo", "vexo", "grum"]
    nothing = toxicity.train(docs, lab.limit(0))
    assert {x.score for x in toxicity.score_documents(docs.drop("toxic_spans"), nothing).collect()} == {toxicity.Field.score(nothing, __import__("numpy").zeros(0))}


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    f = toxicity.Field(np.zeros(0, np.uint64), np.zeros(0), -0.7, np.array([[0.3, -1.0], [0.5, 0.2]]))
    n, pos, score = 7, np.array([1, 4]), np.array([1.5, -0.4])
    odds = np.full(n, np.exp(-0.7))
    odds[pos] = np.exp(-0.7 + score)
    total, hit = 0.0, np.zeros(2)
    for y in itertools.product((0, 1), repeat=n):
        p, last = 1.0, 0
        for t in range(n):
            p *= np.exp(f.transitions[last, y[t]]) * (odds[t] if y[t] else 1)
            last = y[t]
        total += p
        hit += p * np.array([y[1], y[4]])
    assert np.allclose(f.marginals(pos, score, n), hit / total)


# ---- HTML


def test_article_is_found_among_the_rest():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu</a></li><li><a href='/b'>More</a></li></ul></nav>"
        "<div class='ad'>Buy now at once.</div><article><h1>Head &amp; line</h1><p><b>First words of a  long paragraph, which goes on and on.<br><p>Second one;\nit has a <a href='/x'>link</a> too.</p></article>"
        "<section class='comments'><div class='comment'><p>I disagree.</p></div></section><form><label>Mail</label><input><button>Go</button></form><footer>&copy; site</footer></body></html>"
    )
    (text,) = html_extract.extract_texts(html_extract.model(), [page])
    assert text == "Head & line\nFirst words of a long paragraph, which goes on and on.\nSecond one; it has a link too."


def test_generated_pages_are_decoded_and_consistent():
    maker, forest, exact = html_extract._Maker(random.Random(123)), html_extract.model(), 0
    for _ in range(60):
        page = html_extract.Page(maker.page())
        label = [1 if "x-k" in a else 0 for a in page.attrs]
        page.attrs = [a.replace("x-k", "") for a in page.attrs]
        state = html_extract.decode(page, forest.logit(html_extract.features(page)))
        for i in range(1, len(state)):
            above = state[page.parent[i]]
            assert not (above == html_extract.OUT and state[i] != html_extract.OUT) and not (above == html_extract.MAIN and state[i] == html_extract.AROUND)
        exact += html_extract.blocks(page, label) == html_extract.blocks(page, state)
    assert exact >= 54


def test_odd_html(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "no markup at all, only words"), (4, "u", "<div" * 50), (5, "u", "<p>" * 3000 + "x"), (6, "u", "<script>x"), (6, "u", "<script>x"), (7, None, "<!-- " + "y" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS text", "1 AS n_chars")
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '\"", "<!", "</", "<p>", "<span></x>", "<p><div><span>", "<li><b></li>", "<script>", "a=\"", "&#9", "<!--", "<div class='ad'>x"])
@pytest.mark.parametrize("tail", ["", ">", "'>"])
def test_a_megabyte_of_one_piece_takes_no_more_than_seconds(piece, tail):
    source = piece * (1_000_000 // len(piece)) + tail
    began = time.thread_time()
    html_extract.extract_texts(html_extract.model(), [source])
    assert time.thread_time() - began < 20


def test_numbers_of_very_many_digits():
    assert html_extract.unescape("&#" + "0" * 6000 + "65;&#" + "9" * 6000 + ";&#x41;&amp;&#x110000;") == "A\ufffdA&\ufffd"
    maker = html_extract._Maker(random.Random(5))
    page = html_extract.Page(maker.page())
    whole = html_extract.Measures(page)
    parts = [whole.features(lo, min(lo + 7, whole.n)) for lo in range(0, whole.n, 7)]
    assert (np.concatenate(parts) == html_extract.features(page)).all()


# ---- chat


def test_chat_round_trip(spark):
    texts = ["plain", "\\### Assistant: </turn> ok", "<+>", "### ", "###", "</turn", "</turn>\n", "\\b\\h", "", None, "é😀\n", ": :", "###  </turn><+>\\"]
    rows, n = [], 0
    r = random.Random(0)
    for c in range(30):
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", "assistant", "sys: tem", "### x", None]), r.choice(texts)))
    rows += [(99, 0, "user", "twice"), (99, 0, "user", "twice"), (99, None, "user", "first"), (None, 0, "assistant", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS messages", "3 AS formatted")
    back = {x.conv_id: x for x in chat.read_back(chat.format_chats(df)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert len(back) == len(by)
    for c, turns in by.items():
        turns.sort()
        assert [(x.role, x.text) for x in back[c].turns] == [t[1:] for t in turns]
        assert back[c].loss_text == "".join(t[2] for t in turns if t[1] == "assistant")
    assert chat.format_chats(df.limit(0)).count() == 0


# ---- URLs


def judge(url, rules):
    m = re.match(r"(?s)\A.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
    fit = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1:] if fit else (None, None)


@pytest.mark.parametrize("limit", [urlfilter.MAX_BROADCAST_KEYS, 0])
def test_urls(spark, limit, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_BROADCAST_KEYS", limit)
    r = random.Random(1)
    urls = [None, "", "no scheme", "://", "http://", "http://COM/en/", "http://xcom/en/1", "a://b://c/en/", "http://example.com/en/7?x#y", "http://m.Example.com/en/70", "http://com/en", "http://example.com?/en/7", "http://net#/de/8", "http://a.b.example.net/de/81", "http://.com/en/x"]
    for _ in range(300):
        urls.append(f"{r.choice(('http', 'https'))}://{r.choice(('', 'www.', 'M.'))}{r.choice(('a', 'spam-farm'))}.{r.choice(('example', 'other'))}.{r.choice(('com', 'net', 'org'))}/{r.choice(('en', 'de', 'es'))}/{r.randrange(900)}{r.choice(('', '?q=1', '#t', '/'))}")
    rows = list(enumerate(urls)) + [(3, urls[3]), (5, urls[5]), (5, urls[5])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule", "3 AS key")
    rules = urlfilter.rule_frame(spark, urlfilter.RULES, 1).unionByName(urlfilter.rule_frame(spark, urlfilter.LISTED, 0))
    got = sorted((x.page_id, x.host, x.path, x.rule or "", x.verdict) for x in urlfilter.judge_urls(df, rules).collect())
    want = []
    for i, u in rows:
        host, path, (rule, verdict) = judge(u, urlfilter.RULES)
        verdict = verdict or judge(u, urlfilter.LISTED)[2][1] or "allow"
        want.append((i, host, path, rule or "", verdict))
    assert got == sorted(want)
    assert urlfilter.judge_urls(df.limit(0), rules).count() == 0
    none = local_rows(spark, [("", "", "", 0, 0, 0, 0)], "key string, rule string, verdict string, tier int, size int, labels int, path_len int").limit(0)
    assert urlfilter.judge_urls(df, none).where("verdict = 'allow'").count() == len(rows)


def best_windows(rows, items, k=5, threshold=0.8):
    """{(doc, item): best weighted similarity over every window of the item's length}, by plain loops."""
    words = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    told = {i: words(t) for i, t in items}
    held = {}
    for i, w in told.items():
        for g in set(grams(w, min(k, len(w)))):
            held.setdefault(g, set()).add(i)
    weight = lambda g: np.log(1 + len(items) / len(held[g])) if g in held else np.log(1 + len(items))
    out = {}
    for d, t in rows:
        w = words(t or "")
        for i, x in told.items():
            n = min(k, len(x))
            a = set(grams(x, n))
            all_ = grams(w, n)
            size = len(x) - n + 1
            if not a.intersection(all_):
                continue
            for s in range(max(1, len(all_) - size + 1)):
                b = set(all_[s : s + size])
                if a & b:
                    both, either = (sum(map(weight, y)) for y in (a & b, a | b))
                    out[d, i] = max(out.get((d, i), 0.0), both / either)
    return out


def test_leaks_equal_brute_force_over_every_window(spark, docs_of, prose):
    r = random.Random(12)
    items = [(i, prose(900 + i, r.choice((3, 12, 30, 45, 60)))) for i in range(30)]
    items += [(40, items[4][1]), (41, " ".join(items[2][1].split()[:20] + prose(77, 15).split()))]
    rows = []
    for d in range(150):
        w = r.choice(items)[1].split()
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            at, kind = r.randrange(len(w)), r.random()
            if kind < 0.6:
                w[at] = f"e{r.randrange(99)}"
            elif kind < 0.8:
                w.insert(at, f"e{r.randrange(99)}")
            elif len(w) > 1:
                del w[at]
        rows.append((d, f"{prose(2000 + d, r.randrange(60))} {' '.join(w)} {prose(5000 + d, r.randrange(60))}"))
    rows += [(500, prose("unlike", 300)), (501, None), (502, "")]
    best = best_windows(rows, items)
    want = {x for x, v in best.items() if v >= 0.8 - 1e-9}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.leaks(docs_of(rows), bench).collect()}
    assert not set(got) - want and len(want) > 60
    assert all(v <= best[x] + 1e-6 for x, v in got.items())
    close = {x for x in want if best[x] < 0.9}
    assert len(set(got) & want) >= 0.98 * len(want) and len(set(got) & close) >= 0.9 * len(close), sorted((x, best[x]) for x in want - set(got))
