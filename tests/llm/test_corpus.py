"""Quality rules, mixing, sharding, PPM scores, HTML extraction and the pipeline."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftline.llm import html, ppm, quality
from driftline.llm.html import extract, main_text
from driftline.llm.mixing import Mix, calibrated, mix_sources, rake, supplied
from driftline.llm.ppm import SYMBOLS, adaptive_score, score_documents
from driftline.llm.quality import Rules, js_distance, quality_rules
from driftline.llm.topics import TopicModel, with_topics
from driftline.llm.sharding import shard, write_shards

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def base_of(text):
    words = SPACE.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_base_measures(docs, rows):
    loop = " ".join(["again and again the same eight words come round"] * 6)
    extra = docs.sparkSession.createDataFrame([(900, f"a\na\n \n\nb|b\na\n{loop}", "en"), (901, loop, None)], "doc_id long, text string, lang string")
    got = quality_rules(docs.select("doc_id", "text", "lang").union(extra)).select("doc_id", "text", "quality.*").collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_of(r["text"])
        assert not (r["kept"] and r["base_failed"])


def test_quality_verdict_separates(spark, rows):
    clean = [(i, r[1], "en") for i, r in enumerate(rows) if r[1] and len(r[1].split()) >= 60]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in t.split()), lang) for i, t, lang in clean[:6]] + [(2000 + i, " | ".join("x" + w for w in t.split()), lang) for i, t, lang in clean[:6]]
    got = quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).select("doc_id", "quality.kept").collect()
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {i for i, *_ in clean} <= kept and not any(i >= 1000 for i in kept)


def test_quality_keeps_columns(docs, nothing):
    kept = quality_rules(docs.withColumn("quality", F.lit(3)), only_kept=True)
    assert kept.columns == [*docs.columns, "quality"] and 0 < kept.count() < docs.count()
    assert quality_rules(nothing).collect() == []


def reference_of(rows, width):
    """By language and for '' (all): class counts, all words and the most common ones, from the definition."""
    kinds, total, words = defaultdict(Counter), Counter(), defaultdict(Counter)
    for r in rows:
        for lang in {r[2] or "", ""}:
            kinds[lang].update(quality.CLASS_OF[c.encode()[0]] for c in r[1] or "")
            for w in SPACE.findall(r[1] or ""):
                total[lang] += 1
                words[lang][w.lower().strip(".,;:!?'\"()")] += 1
    return kinds, total, {k: {w: n for w, n in c.items() if w} for k, c in words.items()}


def js(p, q):
    p, q = {k: n / sum(p.values()) for k, n in p.items()}, {k: n / sum(q.values()) for k, n in q.items()}
    half = lambda a: sum(x * math.log2(x / ((p.get(k, 0) + q.get(k, 0)) / 2)) for k, x in a.items() if x)
    return math.sqrt(max(0.0, (half(p) + half(q)) / 2))


def test_quality_distances_by_brute_force(docs, rows, monkeypatch):
    kinds, total, words = reference_of(rows, 48)
    rank = lambda c: sorted(c.items(), key=lambda x: (-x[1], int(quality.hashes(pa.array([x[0]])).view(np.int64)[0])))[:48]
    common = {k: dict(rank(c)) for k, c in words.items()}
    monkeypatch.setattr(quality, "HELD", 50)
    runs = [quality_rules(docs.select("doc_id", "text", "lang").repartition(n)).select("doc_id", "text", "lang", "quality.*").collect() for n in (1, 7)]
    assert sorted(map(str, runs[0])) == sorted(map(str, runs[1]))
    rules = Rules()
    for r in runs[0]:
        text, lang = r["text"] or "", r["lang"] or ""
        found = SPACE.findall(text)
        own = Counter(w if w in common[lang] else None for w in (x.lower().strip(".,;:!?'\"()") for x in found))
        reference = {**common[lang], None: total[lang] - sum(common[lang].values())}
        by_class = js(Counter(quality.CLASS_OF[c.encode()[0]] for c in text), kinds[lang]) if text else 0.0
        by_word = js(own, reference) if found else 0.0
        assert math.isclose(r["class_distance"], by_class, abs_tol=1e-6) and math.isclose(r["word_distance"], by_word, abs_tol=1e-6)
        out = len(text) >= rules.min_chars and by_class > rules.max_class_distance or len(found) >= rules.min_words and by_word > rules.max_word_distance + rules.word_allowance / math.sqrt(max(1, len(found)))
        assert r["kept"] == (not r["base_failed"] and not out)


def test_js_distance():
    p, q = np.array([[1, 1, 0], [4, 4, 0], [0, 0, 0]]), np.array([[1, 1, 0], [0, 0, 5], [1, 2, 3]])
    assert js_distance(p, q).round(9).tolist() == [0, 1, 0]


def test_rake_meets_margins():
    rng = np.random.default_rng(2)
    cells = [(a, b, c) for a in range(4) for b in range(3) for c in range(2)]
    codes = [np.array([x[k] for x in cells]) for k in range(3)]
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25]), np.array([0.7, 0.3])]
    tokens = rng.uniform(1, 50, len(cells))
    for budget in (0.05, 0.4):  # at the larger one some cells are kept whole
        fit = rake(tokens, codes, [budget * tokens.sum() * t for t in targets])
        assert fit.met and fit.probability.max() <= 1 and (budget < 0.4 or (fit.probability == 1).any())
        for code, target in zip(codes, targets):
            assert np.allclose(np.bincount(code, tokens * fit.probability), budget * tokens.sum() * target, rtol=1e-4)


def test_mixing_keeps_scarce_values_whole():
    cells = [{"source": s, "lang": v, "topic": "x", "tokens": n} for s, v, n in [("a", "en", 900), ("a", "de", 50), ("b", "en", 40), ("b", "de", 10)]]
    rows, met, wanted = calibrated(cells, Mix(targets={"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "de": 0.5}}, budget=0.5))
    kept = {r[:2]: r[3] * c["tokens"] for r, c in zip(rows, cells)}
    # b has 50 tokens and German 60, less than half of 500: all are kept, and English in a fills up
    assert met and abs(wanted - 500) < 1e-6 and np.allclose([kept["b", "en"], kept["b", "de"], kept["a", "de"], kept["a", "en"]], [40, 10, 50, 400], atol=0.01)
    assert np.allclose(supplied(np.array([0.5, 0.3, 0.2]), np.array([10.0, 100.0, 100.0]), 100), [10, 54, 36])


def test_mixing_takes_the_largest_budget():
    # half of the tokens in a, half in German: both lie in one cell, so no more than 30 of each can be had
    cells = [{"source": s, "lang": v, "topic": "x", "tokens": n} for s, v, n in [("a", "de", 30), ("b", "de", 70), ("b", "en", 100)]]
    rows, met, wanted = calibrated(cells, Mix(targets={"source": {"a": 0.3, "b": 0.7}, "lang": {"en": 0.3, "de": 0.7}}, budget=0.9))
    kept = [r[3] * c["tokens"] for r, c in zip(rows, cells)]
    assert met and abs(sum(kept) - wanted) < 0.01 and wanted > 100 and max(r[3] for r in rows) <= 1
    with pytest.warns(UserWarning):
        cells = [{"source": s, "lang": v, "topic": "x", "tokens": 50} for s, v in (("a", "en"), ("b", "de"))]
        assert not calibrated(cells, Mix(targets={"source": {"a": 0.5}, "lang": {"en": 0.1}}, budget=0.1))[1]


def test_mixing(docs, rows, nothing):
    mix = Mix(targets={"source": {"hot": 0.2, "a": 0.4, "b": 0.4}, "lang": {"en": 0.5, "de": 0.3, "": 0.2}}, budget=0.2)
    words = lambda r: len(SPACE.findall(r["text"] or ""))
    df = docs.withColumns({"mix": F.lit(1), "probability": F.lit("p"), "topic": F.lit(3)})
    topic, tokens = F.when(F.length("text") > 300, "long").otherwise("short"), F.regexp_count("text", F.lit("[^ \\x09-\\x0D]+"))
    out = mix_sources(df, tokens, topic, mix)
    assert out.columns == df.columns[: df.columns.index("mix")] + df.columns[df.columns.index("mix") + 1 :] + ["mix"]
    got = out.select("doc_id", "source", "lang", "text", "mix.*").collect()
    assert len(got) == len(rows) and all(r["met"] for r in got)
    cells, kept = defaultdict(float), defaultdict(float)
    for r in got:
        for m, v in (("source", r["source"] or ""), ("lang", r["lang"] or "")):
            kept[m, v] += words(r) * r["probability"]
        cells["all"] += words(r) * r["probability"]
        assert r["topic"] == ("long" if len(r["text"] or "") > 300 else "short")
        if r["source"] is None or (r["lang"] or "") not in mix.targets["lang"]:
            assert r["probability"] == 0 and not r["kept"]
    for m, named in mix.targets.items():
        for v, share in named.items():
            assert abs(kept[m, v] / cells["all"] - share) < 1e-4
    assert abs(cells["all"] / sum(map(words, got)) - 0.2) < 1e-4
    chosen = [r["doc_id"] for r in got if r["kept"]]
    assert chosen and sorted(map(str, chosen)) == sorted(str(r["doc_id"]) for r in mix_sources(df.repartition(3), tokens, topic, mix).filter("mix.kept").collect())
    assert mix_sources(nothing, F.lit(1), F.lit("x")).collect() == []


def test_topics_and_tokens(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    labelled = docs.filter("doc_id < 300").select("doc_id", F.when(F.col("text").contains("edit"), "copy").otherwise("plain").alias("topic"))
    model = TopicModel.fit(docs, labelled)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = with_topics(docs, model, tokenizer=path).collect()
    library = Tokenizer.from_file(path)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(r[0]), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sum((r["topic"] == "copy") == ("edit" in r["text"]) for r in got if r["text"]) > 0.95 * len(rows)
    assert [r["topic"] for r in got if not r["text"]] == ["plain"] * sum(not r[1] for r in rows)
    assert with_topics(nothing, TopicModel.fit(docs, labelled.filter("false"))).collect() == []


def test_sharding(docs, rows, spark, tmp_path, monkeypatch):
    from driftline.llm import sharding

    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    clean = docs.drop("shard")
    placed = shard(clean, 7)
    got = placed.collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    shards, mixture = defaultdict(list), defaultdict(Counter)
    for r in got:
        shards[r["shard"]].append(r["slot"])
        mixture[r["source"]][r["shard"]] += 1
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(shards) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    for c in mixture.values():
        assert max(c[k] for k in range(7)) - min(c[k] for k in range(7)) <= 2
    again = {(r["doc_id"], r["text_crc32"]): (r["shard"], r["slot"]) for r in shard(clean.repartition(2), 7).collect()}
    unique = [k for k, n in Counter((r["doc_id"], r["text_crc32"]) for r in got).items() if n == 1]
    mine = {(r["doc_id"], r["text_crc32"]): (r["shard"], r["slot"]) for r in got}
    assert all(again[k] == mine[k] for k in unique)
    assert shard(clean.filter("false"), 7).collect() == [] and shard(clean.limit(3), 7).count() == 3
    some = clean.filter("doc_id < 100").dropDuplicates(["doc_id"])
    write_shards(some, shard(some, 3), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == some.count()


def naive_ppm(counts, context, symbol):
    """P(symbol) after ``context``, straight from the definition; counts: context -> Counter."""
    excluded, p = set(), 1.0
    for k in range(len(context), -1, -1):
        held = {s: n for s, n in counts.get(context[len(context) - k :], {}).items() if s not in excluded}
        n = sum(held.values())
        if not n:
            continue
        if symbol in held:
            return p * (2 * held[symbol] - 1) / (2 * n)
        p *= len(held) / (2 * n)
        excluded |= set(held)
    return p / (SYMBOLS - len(excluded))


def test_ppm_matches_the_definition(docs, rows):
    got = score_documents(docs).collect()
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    held = [zlib.crc32(str("null" if r[0] is None else r[0]).encode()) % 7 == 2 for r in rows]
    counts, words, docs_in = defaultdict(Counter), Counter(), 0
    for r, out in zip(rows, held):
        if not out:
            docs_in += 1
            words.update(SPACE.findall(lower(r[1])))
            s = (ppm.PAD,) * ppm.ORDER + tuple(lower(r[1]).encode()) + (ppm.END,)
            for i in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    counts[s[i - k : i]][s[i]] += 1
    total, distinct = sum(words.values()) + docs_in, len(words) + 1
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    checked = 0
    for r, out in zip(rows, held):
        ws, mine = SPACE.findall(lower(r[1])), None
        for g in by_id[r[0]]:
            if g["n_tokens"] == len(ws) + 1:
                mine = g
        assert mine is not None and mine["held_out"] == out and mine["train_tokens"] == total
        c = [words[w] for w in ws] + [docs_in]
        assert mine["n_known"] == sum(x > 0 for x in c)
        assert math.isclose(mine["base_score"], sum(math.log10((x + 1) / (total + distinct + 1)) for x in c), rel_tol=1e-9)
        if len(lower(r[1])) < 400 and r[0] != 7:
            s = (ppm.PAD,) * ppm.ORDER + tuple(lower(r[1]).encode()) + (ppm.END,)
            want = sum(math.log10(naive_ppm(counts, s[i - ppm.ORDER : i], s[i])) for i in range(ppm.ORDER, len(s)))
            assert math.isclose(mine["score"], want, rel_tol=1e-5, abs_tol=1e-4)
            checked += 1
    assert checked > 50
    mean = lambda f: sum(r["score"] for r in got if f(r)) / sum(r["n_tokens"] for r in got if f(r))
    assert mean(lambda r: r["held_out"]) > -SYMBOLS and len(got) == len(rows)


def test_ppm_rare_words_join(docs, monkeypatch):
    want = {(r["doc_id"], r["n_tokens"]): r["base_score"] for r in score_documents(docs).collect()}
    monkeypatch.setattr(ppm, "FREQUENT", 5)
    for r in score_documents(docs).collect():
        assert math.isclose(r["base_score"], want[r["doc_id"], r["n_tokens"]], rel_tol=1e-9)


def test_ppm_scores_do_not_depend_on_the_cache(docs, monkeypatch):
    want = {(r["doc_id"], r["n_tokens"]): r["score"] for r in score_documents(docs).collect()}
    for limit in (0, 500):
        monkeypatch.setattr(ppm, "CACHE", limit)
        for r in score_documents(docs).collect():
            assert math.isclose(r["score"], want[r["doc_id"], r["n_tokens"]], rel_tol=1e-9, abs_tol=1e-9)


def test_ppm_distributions_sum_to_one():
    code, n = ppm.counted(ppm.grams(ppm.symbols(pa.array(["abracadabra abracadabra"]))[0]).view(np.int64))
    low = ppm.low_levels(*ppm.summed(code & ppm.mask(ppm.SPLIT), n))
    contexts = np.unique(np.concatenate([code >> ppm.BITS, [ord("q")]]))
    every = np.sort(((contexts[:, None] << ppm.BITS) + np.arange(SYMBOLS)).ravel())
    at = np.searchsorted(code, every)
    times = np.where(code[np.minimum(at, len(code) - 1)] == every, n[np.minimum(at, len(code) - 1)], 0)
    p = 10 ** ppm.prices(every, times, low)
    assert np.allclose(p.reshape(-1, SYMBOLS).sum(1), 1)


def test_ppm_edges(nothing, docs):
    assert score_documents(nothing).collect() == []
    none = score_documents(docs.limit(4), F.lit(True)).collect()
    assert all(math.isclose(r["score"] / -math.log10(SYMBOLS), round(r["score"] / -math.log10(SYMBOLS)), abs_tol=1e-4) and r["n_known"] == 0 for r in none)
    assert adaptive_score(b"abababababababab") > adaptive_score(b"aqwszxedcrfvtgby") and adaptive_score(b"") < 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies, all of them.</div>
<div id="wrapper" class="has-sidebar"><article><header><h1>The &amp; title</h1></header><p>First <b>para</b>graph,\n with&nbsp;a <a href="x">link</a>.<br>And a line.<p>Second, unclosed; it is longer than the others by some words.
<div class="ad">Buy this, now!</div><ul><li>One<li>Two</ul><p>Of.</p><form><input><p>Subscribe here.</p></form><section id="comments"><article class="comment"><p>Nice post, thanks for it.</p></article></section></article>
<aside><p>Related reading of some length, and more of it.</p></aside></div><footer>&copy; Someone</footer></body></html>"""


def test_html_article():
    assert main_text(PAGE) == "The & title First paragraph, with a link. And a line. Second, unclosed; it is longer than the others by some words. One Two Of."


def test_html_without_semantics():
    body = "".join(f"<p>Sentence {i}, with a clause of its own, and then the rest of it. It goes on for a while.</p>" for i in range(6))
    page = f'<body><div><a href="/">Home</a> <a href="/b">About us</a></div><div><div><h1>Head</h1>{body}</div></div><div><a href="/c">Privacy</a></div></body>'
    text = main_text(page)
    assert text.startswith("Head Sentence 0,") and text.endswith("for a while.") and "Privacy" not in text and "Home" not in text


PARAGRAPHS = "".join(f"<p>Sentence {i}, with a clause of its own, and then the rest of it. It goes on for a while.</p>" for i in range(6))


@pytest.mark.parametrize("tag", ["article class='post category-legal'", "article class='post tag-search'", "div class='elementor-widget'", "div id='promo'"])
def test_html_names_are_hints(tag):
    text = main_text(f"<body><div>Home page</div><{tag}><h1>Head</h1>{PARAGRAPHS}<div class='ad'>Buy, now!</div></{tag.split()[0]}><div class='share'>Tell others</div></body>")
    assert "Head Sentence 0," in text and text.count("for a while.") == 6 and "Buy" not in text and "Tell" not in text


def test_html_selects_inside_the_container():
    links = "".join(f'<li><a href="/{i}">Another page, number {i}</a></li>' for i in range(5))
    text = main_text(f"<main><article><h1>Head</h1>{PARAGRAPHS}<ul>{links}</ul><p>End.</p></article><div><div>Side column</div><ul>{links}</ul></div></main>")
    assert text.startswith("Head Sentence 0,") and text.endswith("for a while. End.") and "Another" not in text and "Side" not in text
    text = main_text(f"<main><h1>Head</h1>{PARAGRAPHS}<ul>{links}</ul><p>End.</p></main>")
    assert text.endswith("for a while. End.") and "Another" not in text


def test_html_keeps_smaller_articles():
    more = "<p>A second article, shorter than the first one; it has a single paragraph. But it is text.</p>"
    text = main_text(f"<body><article><h1>Head</h1>{PARAGRAPHS}</article><article>{more}</article><article><a href='/x'>To another page, by its title</a></article></body>")
    assert text.endswith("But it is text.") and text.startswith("Head")


@pytest.mark.parametrize("page", [None, "", "   ", "<html>", "<!-- never closed <p>x", "<script>var x = '<p>no</p>'", "<nav>menu</nav>"])
def test_html_empty(page):
    assert main_text(page) == ""


def test_html_broken():
    assert main_text("<article><h1>A</h1><p><b>One.<br><p>Two &a &amp three.</p><p>Cut o") == "A One. Two &a & three. Cut o"
    assert main_text("<article><p>1 < 2 and 3 > 2 <span>in</span>line</p>") == "1 < 2 and 3 > 2 inline"


@pytest.mark.parametrize("wrap", ['div class="tags-article content share"', 'div id="comments-archive-article"', 'form id="page"'])
def test_html_frames_are_read(wrap):
    text = main_text(f"<body><nav><a href='/'>Home</a></nav><{wrap}>{PARAGRAPHS}</{wrap.split()[0]}></body>")
    assert text.startswith("Sentence 0,") and text.count("for a while.") == 6


@pytest.mark.parametrize("name", ["reader-feedback", "user-opinions", "comments"])
def test_html_reader_comments_go(name):
    comments = f'<div class="{name}"><p>I like this post, thanks.</p><p>Me too, I think so, it is great; my view is the very same as yours here.</p></div>'
    for page in (f"<article>{PARAGRAPHS}{comments}</article>", f"<article>{PARAGRAPHS}</article>{comments}", f"<div><div>{PARAGRAPHS}</div>{comments}</div>"):
        assert main_text(page).endswith("for a while.")


def test_html_unbalanced_quotes():
    assert main_text('<p title="x>Hello there, world.</p>') == "Hello there, world."
    assert main_text('<article><p>See <a href="x>link</a> here, please.</p></article>') == "See link here, please."


def test_html_scores_decide(monkeypatch):
    want = main_text(PAGE)
    monkeypatch.setattr(html, "scores", lambda blocks: [100.0] * len(blocks))
    assert main_text(PAGE) != want and "Buy this" in main_text(PAGE)


@pytest.mark.parametrize(
    "inner, want",
    [
        ("<p>The <span class='search-term'>apple</span> fell. <em class='related'>Really</em> it did.</p>", "The apple fell. Really it did."),
        ("<p>See <a class='reply' href='/r'>the earlier report</a> for more, and all else.</p>", "See the earlier report for more, and all else."),
        ("<table><tr><td>1<td>2<tr><td>3<td>4</table>", "1 2 3 4"),
        ("<h2>References</h2><ul><li>Smith 1999<li>Jones 2001</ul>", "References Smith 1999 Jones 2001"),
        ("<ul><li>Ingredient one<li>Ingredient two</ul>", "Ingredient one Ingredient two"),
        ("<p>where <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is</p>", "where x+1 is"),
        ("<xmp><b>as it stands</b></xmp>", "<b>as it stands</b>"),
        ("<p>A <video src='v'>film of it</video> here.</p>", "A film of it here."),
    ],
)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_html_keeps_the_whole_article(inner, want, tag):
    """Named inline elements, tables, lists and formulas, at the end of an article with and without its element's name."""
    page = f"<body><nav><a href='/'>Home</a></nav><div><{tag}><h1>Head</h1>{PARAGRAPHS}{inner}</{tag}></div><footer>Imprint</footer></body>"
    text = main_text(page)
    assert text.startswith("Head Sentence 0,") and text.endswith(f"for a while. {want}")


def page_by_ratio(rng):
    """A page without any telling name: an article's div among columns of short texts; the article's words."""
    sentence = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."
    body = [f"<p>{sentence(rng.randint(20, 60))} {sentence(12)}</p>" for _ in range(rng.randint(3, 8))]
    if rng.random() < 0.5:
        body.insert(2, "<ul>" + "".join(f"<li>{sentence(3)}</li>" for _ in range(4)) + "</ul>")
    inner = f"<h1>{sentence(5)}</h1>" + "".join(body)
    column = lambda: "<div>" + "".join(f"<div><span>side {rng.randint(0, 99)}</span> {rng.choice(['more', 'top ten', 'new today'])}</div>" for _ in range(rng.randint(2, 12))) + "</div>"
    own = " ".join(re.sub("<[^>]*>", " ", inner).split())
    return f"<body><div>{column()}<div>{inner}</div>{column()}</div>{column()}</body>", own


def test_html_ratios_separate_where_no_name_does(monkeypatch):
    rng = random.Random(3)
    pages = [page_by_ratio(rng) for _ in range(60)]
    assert [main_text(page) for page, _ in pages] == [own for _, own in pages]
    monkeypatch.setattr(html, "scores", lambda blocks: [100.0] * len(blocks))
    assert sum(main_text(page) == own for page, own in pages) == 0


def test_html_test_pages_without_the_article_element(spark):
    """The test pages' articles to the last word, with the element and without its name."""
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        inner = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        plain = row.html.replace("<article>", "<div>").replace("</article>", "</div>")
        words = re.sub(r"<[^>]*>", " ", inner)
        own = html.unescape(words).split()
        assert main_text(row.html).split() == own and main_text(plain).split() == own


def test_html_deep_nesting_is_linear():
    began = time.time()
    for tag in ("div", "article", "section class='widget'", "blockquote"):
        name = tag.split()[0]
        text = main_text("".join(f"<{tag}>t{i} " for i in range(20_000)) + PARAGRAPHS + f"</{name}>" * 20_000)
        assert text.count("for a while.") == 6 or "widget" in tag
    assert time.time() - began < 20


def test_html_scores_by_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        blocks = [
            html.Block("".join(rng.choice("ab ,.") for _ in range(rng.randint(1, 60))) + "x", 0, 0, rng.choice([("body", "p"), ("body", "div"), ("body", "div", "p"), ()]), rng.random() < 0.3)
            for _ in range(rng.randint(1, 12))
        ]
        for b in blocks:
            b.links = rng.randint(0, b.size)
        mine = lambda b: [x for x in blocks if x.path == b.path and x.low == b.low]
        text = [sum(x.size - x.links for x in mine(b)) / len(mine(b)) for b in blocks]
        marks = [sum(sum(c in ",." for c in x.text) for x in mine(b)) / len(mine(b)) for b in blocks]
        near = lambda v, i: 0.25 * v[max(i - 1, 0)] + 0.5 * v[i] + 0.25 * v[min(i + 1, len(v) - 1)]
        want = [near(text, i) * (1 + near(marks, i)) ** 0.5 * (0.05 if b.low else 1) for i, b in enumerate(blocks)]
        got = html.scores(blocks)
        assert np.allclose(got, want)
        best = [w for w, b in zip(want, blocks) if not b.low]
        limit = max(2.0, min(0.4 * np.std(want), max(best) / 2)) if best else math.inf
        assert math.isclose(html.threshold(blocks, got), limit)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    got = extract(df).orderBy("page_id").collect()
    assert [r["n_chars"] for r in got] == [len(main_text(PAGE)), 0, 0] and got[1]["text"] == ""
    assert extract(df.filter("false")).collect() == []


def independently_raked(cells, mix):
    """Plain raking by dictionaries: kept tokens of each margin value are brought to their target in turn."""
    total = sum(cells.values())
    names = ("source", "lang", "topic")
    goals = []
    for i, m in enumerate(names):
        have = Counter()
        for c, n in cells.items():
            have[c[i]] += n
        named = mix.targets.get(m, {})
        free = {v: n**mix.temperature for v, n in have.items() if v not in named}
        share = {v: named.get(v, (1 - sum(named.values())) * free.get(v, 0) / sum(free.values()) if free else 0) for v in have}
        goals.append({v: s / sum(share.values()) * mix.budget * total for v, s in share.items()})
        assert all(goals[i][v] < have[v] for v in have)  # no value falls short in these tests
    f = [dict.fromkeys(g, 1.0) for g in goals]
    chance = lambda c: min(1.0, f[0][c[0]] * f[1][c[1]] * f[2][c[2]])
    for _ in range(300):
        for i in range(3):
            now = Counter()
            for c, n in cells.items():
                now[c[i]] += n * chance(c)
            for v in f[i]:
                f[i][v] *= goals[i][v] / now[v]
    return {c: chance(c) for c in cells}


@pytest.mark.parametrize("limit", [1 << 16, 10])
def test_mixing_is_raking(spark, monkeypatch, limit):
    """On the driver and in Spark: the probabilities of an independent raking."""
    from driftline.llm import mixing

    monkeypatch.setattr(mixing, "MAX_CELLS", limit)
    rng = random.Random(9)
    rows = [(i, f"s{min(rng.randrange(40), rng.randrange(40))}", rng.choice("abc"), rng.choice("xyy"), rng.randint(1, 50)) for i in range(3000)]
    mix = Mix(targets={"lang": {"a": 0.4}, "topic": {"x": 0.3}}, budget=0.3)
    cells = Counter()
    for _, s, l, t, n in rows:  # noqa: E741
        cells[s, l, t] += n
    want = independently_raked(cells, mix)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, t string, n long")
    got = mix_sources(df.withColumn("a.b", F.lit(1)).withColumn("cell", F.lit(2)), F.col("n"), F.col("t"), mix)
    assert got.columns == ["doc_id", "source", "lang", "t", "n", "a.b", "cell", "mix"]
    found = got.collect()
    assert len(found) == 3000 and all(r.mix.met and abs(r.mix.probability - want[r.source, r.lang, r.t]) < 1e-4 for r in found)


def test_mixing_of_very_many_sources(spark):
    """Seventy thousand sources, one of them hot: a result, and the margins of what is kept."""
    n = 140_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("h"), F.col("id"))).alias("source"), F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("lang"))
    mix = Mix(targets={"source": {"hot": 0.2}, "lang": {"a": 0.3}}, budget=0.4)
    made = mix_sources(df, F.lit(10), F.lit(None), mix)
    kept = made.agg(F.count("*").alias("n"), F.sum("mix.probability").alias("all"), F.sum(F.when(F.col("source") == "hot", F.col("mix.probability"))).alias("hot"), F.sum(F.when(F.col("lang") == "a", F.col("mix.probability"))).alias("a"), F.bool_and("mix.met").alias("met")).first()
    assert kept["n"] == n and kept["met"] and abs(kept["all"] - 0.4 * n) < 10 and abs(kept["hot"] / kept["all"] - 0.2) < 1e-4 and abs(kept["a"] / kept["all"] - 0.3) < 1e-4


def test_operators_take_any_names(spark, docs, monkeypatch):
    """Columns with dots, with one underscore and with the operators' own names stay as they are."""
    from driftline.llm import quality as rules
    from driftline.llm.packing import pieces
    from driftline.llm.token_counts import token_counts

    monkeypatch.setattr(rules, "MAX_LANGS", 1)  # the others are judged by the pool
    file = public_tokenizers.path("word_bpe_49k.json")
    df = docs.select("doc_id", "text", "lang", "source").limit(40).withColumn("a.b", F.col("doc_id") + 1).withColumn("_", F.lit(2)).withColumn("_key", F.lit(3)).withColumn("in0_", F.lit(4))
    model = TopicModel.fit(docs, docs.select("doc_id", F.lit("t").alias("topic")).filter("doc_id < 20"))
    made = {
        "pieces": pieces(df, file), "token_counts": token_counts(df, public_tokenizers.path("byte_bpe_50k.json")), "quality_rules": quality_rules(df), "kept": quality_rules(df, only_kept=True),
        "with_topics": with_topics(df, model, tokenizer=file), "shard": shard(df, 3), "extract": extract(df, "text"),
    }
    for name, out in made.items():
        assert {"a.b", "_", "_key", "in0_"} <= set(out.columns), name
        for r in out.collect():
            assert r["_"] == 2 and r["_key"] == 3 and r["in0_"] == 4 and (r["doc_id"] is None or r["a.b"] == r["doc_id"] + 1), name


def test_sharding_of_null_ids_is_split(spark):
    """Rows without ids are shuffled by their texts, over many buckets."""
    rows = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("s").alias("source"))
    made = shard(rows, 4).select("shard", "slot", "text_crc32").collect()
    assert sorted(Counter(r.shard for r in made).values()) == [2500] * 4 and len({(r.shard, r.slot) for r in made}) == 10_000
    assert len({r.text_crc32 for r in made if r.shard == 0}) > 2000
    again = shard(rows.repartition(7), 4).select("shard", "slot", "text_crc32").collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, again))


def test_pipeline_stages(spark, docs, rows, tmp_path):
    spark.range(0, 300, 2).selectExpr("id as doc_id", "cast(id % 10 > 0 as int) as quality", "cast(id % 40 = 0 as int) as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs.select("doc_id", "text", "lang", "source").withColumn("n_chars", F.length("text").cast("long")).withColumn("mix", F.lit("m")).withColumn("topic", F.lit("t"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, str(tmp_path))
        if k < 3:
            assert after.columns == now.columns
            assert not Counter(after.collect()) - Counter(now.collect())  # stages only choose
            now = after.cache()
            assert now.count() > 0
        else:
            assert after.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
