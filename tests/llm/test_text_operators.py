"""Each text operator against a plain version on small tables, and on odd rows."""

import gzip
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.llm import components, decontaminate, html_text, langid, license_scan, line_dedup, minhash, mixing, quality, sstable, warc
from rangeloom.llm.queries import tokenizer_path

ODD = [(None, None, None), (1, "", "a"), (2, " \n\t ", None), (3, "word", "a"), (3, "word", "a"), (4, "x " * 60000, "b"), (5, None, "b"), (None, "some words stand here in a row", None)]
SCHEMA = "doc_id long, text string, source string, id string, n string, start string, key string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame([(*r, "i", "n", "s", "k", "en") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


LETTERS = str.maketrans("0123456789", "abcdefghij")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}".translate(LETTERS) for _ in range(n))


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


# op 1


def brute_quality(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_quality_measures(spark):
    rng = random.Random(1)
    texts = [None, "", "a b c a b c", "é é é é", "same\nsame\n\nsame\x0b", "a|b <c> #d"] + [prose(rng, rng.randrange(80), 5) + "\n" * rng.randrange(3) + prose(rng, 4, 3) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.quality_cascade(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_order_leaves_verdicts(spark):
    rng = random.Random(2)
    texts = [prose(rng, 80), prose(rng, 80).upper(), " ".join(x + "###" for x in prose(rng, 80).split()), "12345 " * 70]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rules = quality.default_rules()
    a = {r.doc_id: r.kept for r in quality.quality_cascade(df, rules=rules).collect()}
    b = {r.doc_id: r.kept for r in quality.quality_cascade(df, rules=rules[::-1]).collect()}
    assert a == b and a[0] and not a[1] and not a[2] and not a[3]


def test_quality_odd_rows(odd, none):
    assert quality.quality_cascade(odd).count() == len(ODD)
    assert quality.quality_cascade(none).count() == 0


# op 2


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a", big), (7, "http://b", big), (3, None, "small"), (4, "u", "small"), (5, "u\r\nX: y", None), (None, "u", big), (7, "http://b", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("last", F.lit(2))
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.html) for r in warc.round_trip(spark, df).collect()}
    assert got == {(1, 1200, "revisit", 7, None), (7, 1200, "response", None, big), (3, 5, "response", None, "small"), (4, 5, "response", None, "small"), (5, 0, "response", None, ""), (None, 1200, "revisit", 7, None)}
    assert warc.round_trip(spark, df).count() == len(rows)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_members_and_damage():
    data = warc.page_record(1, "u", b"x" * 5000, None) + warc.page_record(2, "u", b"", None)
    assert gzip.decompress(data).count(b"WARC/1.1") == 2
    read = [warc.payload_of(*r) for r in warc.read_records(io.BytesIO(data))]
    assert read == [b"x" * 5000, b""]
    whole = gzip.decompress(warc.page_record(1, "u", b"payload", None))
    for bad in (gzip.compress(whole.replace(b"payload", b"paylaod")), data[:-9], gzip.compress(whole.replace(b"WARC/1.1", b"NOPE/1.1")), gzip.compress(whole + b"more")):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_records(io.BytesIO(bad)))


# op 3


def test_license_phrases_and_templates(spark):
    from rangeloom.llm.license_templates import TEMPLATES

    mit = re.sub(r"<<var[^>]*>>", "the authors", re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", TEMPLATES["mit#full"]))
    rows = [(1, "Under the MIT license, under\nthe mit LICENSE"), (2, "x " + mit + " y"), (3, mit.replace("sublicense", "relicense")), (4, None), (5, "Licensed under the Apache License, Version 2.0."), (6, "CC BY-NC 4.0")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(0))
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].n_words, got[1].base_labels) == (2, 0, 4, 8, "mit")
    assert got[2].labels == "mit" and got[2].base_labels == "" and got[2].score == 1.0
    assert got[3].labels == "" and got[3].score == 0.0
    assert (got[4].n_words, got[4].first_word, got[4].labels) == (0, None, "")
    assert got[5].labels == "apache-2" and got[6].base_labels == "cc-by-nc"


def test_templates_are_whole_and_matching_is_linear():
    import time

    from rangeloom.llm.license_templates import TEMPLATES

    scanner = license_scan.Scanner()
    full = {k: re.sub(r"<<beginOptional>>(.*?)<<endOptional>>", r"\1", v) for k, v in TEMPLATES.items()}
    holder = "the authors or copyright holders and or their suppliers of " + "Some Long Name " * 12
    for key, text in full.items():
        text, label = re.sub(r"<<var[^>]*>>", holder if "max" not in text else "this program", text), key.partition("#")[0]
        assert label in scanner.scan(text.encode())["labels"], key
        if "#" not in key:
            words = text.split()
            assert label not in scanner.scan(" ".join(words[: len(words) // 2] + ["provided", "nobody", "objects"]).encode())["labels"], key
    changed = full["zlib"].replace("<<var>>", "the authors").replace("plainly marked", "quietly marked").encode()
    assert "zlib" not in scanner.scan(changed)["labels"]
    began = time.perf_counter()
    found = scanner.scan(b"under the MIT license, " * 100_000)
    assert len(found["places"]) == 100_000 and found["places"][-1] == 4 * 99_999 and time.perf_counter() - began < 5


def test_template_regions():
    a = license_scan.compile_template("t", "one two three four <<beginOptional>>five <<beginOptional>>six<<endOptional>><<endOptional>> <<var;max=2>> end here now please")
    accepts = lambda s: a.match(license_scan.tokens(s), 0) is not None
    for middle in ("", "five", "five six", "x", "x y", "five x y", "five six x y"):
        assert accepts(f"one two three four {middle} end here now please"), middle
    for middle in ("x y z", "six x y"):
        assert not accepts(f"one two three four {middle} end here now please"), middle


def test_license_odd_rows(odd, none):
    assert license_scan.scan_licenses(odd).count() == len(ODD)
    assert license_scan.scan_licenses(none).count() == 0


# op 4


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.randrange(3, 120)).split()
        for edits in (0, 0, 1, 2, 3, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [None, "", " ", "one two", "ONE  two"]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) if t else set() for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    for r in minhash.near_duplicates(df).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert {r.doc_id for r in minhash.keep_one(df).collect()} == {find(i) for i in range(len(texts))}


def test_near_duplicates_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and all(r.component_id == r.doc_id for r in rows)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 1 and kept.where("doc_id IS NULL").count() == 2


def test_components_of_a_long_path(spark):
    order = list(range(5000))
    random.Random(6).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    got = components.connected_components(links).collect()
    assert len(got) == 5000 and {r.component for r in got} == {0}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (7, 7)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    group = {x: x for p in links for x in p if None not in p}
    for _ in range(200):
        for a, b in links:
            if a is not None:
                group[a] = group[b] = min(group[a], group[b])
    assert all(got.get(x, x) == g for x, g in group.items())


# op 5

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>First   paragraph
of text that is long enough.<p>Second &eacute; one with <b>bold</b><br>words.</p><div class="share-buttons">Share</div><ul><li>one<li>two</ul>
<section id="comments"><p>A reader says this, at some length, about the article.</p></section></article><aside>Side</aside><form><p>Mail</p></form><footer>&copy; x</footer></body></html>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == "A & B\n\nFirst paragraph of text that is long enough.\n\nSecond é one with bold words.\n\none\n\ntwo"
    plain = "<body><div id=menu><a>1</a><a>2</a></div><div><p>" + "Some words of an article. " * 20 + "</p><p>" + "More of them follow here. " * 20 + "</p></div><div class=footer>foot</div>"
    assert html_text.main_text(plain).startswith("Some words") and "foot" not in html_text.main_text(plain)
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    for broken in ("<", "<p", "<a href='", "</p></div>text", "<![CDATA[x", "<script>never closed", "&#xffffff;", "<!-- open"):
        assert isinstance(html_text.main_text(broken), str)


LONG = "A paragraph of the article that goes on for quite a few words, so that nobody takes it for a menu."


def test_html_named_wrappers():
    for inner in (f"<article><p>{LONG}</p></article>", f"<main><p>{LONG}</p></main>", f"<p>{LONG}</p>"):
        for name in ("class='layout has-sidebar'", "id='content' class='no-comments'"):
            assert html_text.main_text(f"<body><div class=menu><a href=x>Menu</a></div><div {name}>{inner}</div></body>") == LONG
    comments = f"<ol class=comment-list><li><article class=comment-body><p>{LONG} No.</p></article></ol>"
    related = "<div class=related><article><p>Another story</p></article></div>"
    assert html_text.main_text(f"<body><main><article><p>{LONG}</p></article>{related}{comments}</main></body>") == LONG


def test_html_short_lines_between_regions():
    inner = ["Short head", "one", "two", "three", "four", "five", "six"]
    page = f"<div><p>{LONG}</p><p>{LONG}</p><h2>{inner[0]}</h2><ul>" + "".join(f"<li><b><i>{x}</i></b></li>" for x in inner[1:]) + f"</ul><p>{LONG}</p></div>"
    assert html_text.main_text(page).split("\n\n") == [LONG, LONG, *inner, LONG]


def test_html_head():
    page = f"<html><head><title>The title</title><style>p {{ color: red }}</style><script>var a</script><meta name=a></head><body><p>{LONG}</p></body></html>"
    assert html_text.main_text(page) == html_text.main_text(page.replace("</head>", "")) == LONG


def test_html_deep_nesting_is_linear():
    import time

    began = time.perf_counter()
    text = html_text.main_text("<article>" + "<div>" * 30_000 + "words of the article" + "</div>" * 30_000 + "<p>more words</p></article>")
    assert text == "words of the article\n\nmore words" and time.perf_counter() - began < 10


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (None, None, None), (1, "u", PAGE), (2, "u", "<p>" + "long " * 50000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    rows = html_text.extract_pages(df).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)
    assert html_text.extract_pages(df.limit(0)).count() == 0


# op 6


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > cap * sizes[s] + 1e-9}
        if not over:
            return target | {s: w[s] * level for s in open_}
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(200)) or None, rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(600)] + [(1, "again and again", "b")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, block_words=16, shard_words=3000).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    totals = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
    sources = {i: s for i, _, s in rows[:600]}
    for r in got:
        source = "b" if r.size == 3 else sources[r.doc_id]
        totals[source] = totals.get(source, 0) + r.taken
        if r.size != 3:
            assert abs(r.target - want[source]) < 1e-6 and r.source_size == sizes[source]
    for source, taken in totals.items():
        assert abs(taken - want[source]) <= 16 * 12 + 0.01 * want[source]
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix(df.repartition(7), block_words=16, shard_words=3000).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in got}
    mixed = mixing.mixed_documents(df, block_words=16, shard_words=3000)
    words = mixed.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert mixed.columns == df.columns and words == sum(r.taken for r in got)


def test_sainte_lague(spark):
    votes = {"a": 53000, "b": 24000, "c": 23000, "d": 1, "e": 0}
    df = spark.createDataFrame([(1, k, float(v), 17) for k, v in votes.items()], "g int, k string, votes double, seats long")
    got = {r.k: r.quota for r in mixing.sainte_lague(df, ["g"], "k", "votes", "seats").collect()}
    seats = dict.fromkeys(votes, 0)
    for _ in range(17):
        best = max(votes, key=lambda k: (votes[k] / (2 * seats[k] + 1), [-ord(c) for c in k]))
        seats[best] += 1
    assert got == seats


def test_sainte_lague_of_many_small_parties(spark):
    for small in (0.4, 0.6):
        votes = {"big": 60.0} | {f"p{i:03d}": small + i / 1e6 for i in range(100)}
        df = spark.createDataFrame([(1, k, v, 100) for k, v in votes.items()], "g int, k string, votes double, seats long")
        got = {r.k: r.quota for r in mixing.sainte_lague(df, ["g"], "k", "votes", "seats").collect()}
        seats = dict.fromkeys(votes, 0)
        for _ in range(100):
            seats[max(votes, key=lambda k: votes[k] / (2 * seats[k] + 1))] += 1
        assert got == seats and sum(got.values()) == 100


def test_mixed_documents_odd_rows(odd, none):
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert 0 < words(mixed) <= 2 * words(odd) and mixing.mixed_documents(none).count() == 0


def test_mixing_odd_rows(odd, none):
    assert mixing.mix(odd).count() == len(ODD)
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0


# op 7

WORDS = {"en": "the and with that house river under water stone".split(), "fr": "le les avec dans maison rivière été garçon pierre".split(), "de": "der und mit nicht haus fluß über wasser stein".split()}


def test_language_id(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(5, 40))), lang))
    rows += [(1000, None, "en"), (1001, "123 !?", "en"), (1002, "le " * 40000, None), (None, "the and with that", "en"), (5, "the water", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    truth = {i: x for i, _, x in rows[:900]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    by = {r.doc_id: r for r in got}
    assert by[1000].lang_pred == by[1001].lang_pred == "und" and by[1002].lang_pred == "fr" and all(0 <= r.score <= 1 for r in got)
    kept = langid.accepted_rows(df)
    assert kept.columns == df.columns and kept.where("doc_id >= 1000").select("doc_id").collect() == [(1002,)] and kept.count() >= 895
    assert langid.identify(df.limit(0)).count() == 0


def test_language_id_learns_rare_labels_and_rejects_others(spark):
    rng = random.Random(8)
    text = lambda lang: " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(20, 60)))
    rows = [(i, text("en"), "en") for i in range(3000)] + [(i, "the and with that " * 9, "en") for i in range(3000, 6000)]
    rows += [(i, text("fr"), "fr") for i in range(6000, 6020)]
    strange = "käyttö yhtiö sydän hyvää päivää kirja vuosi".split()
    rows += [(i, " ".join(rng.choice(strange) for _ in range(40)), None) for i in range(7000, 7050)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, rows=400).collect()
    rare = [r for r in got if 6000 <= r.doc_id < 6020]
    assert sum(r.lang_pred == "fr" for r in rare) >= 19
    assert sum(not r.accepted for r in got if r.doc_id >= 7000) >= 45
    assert sum(r.accepted for r in got if r.doc_id < 6000) >= 5990


def test_language_id_counts_across_pieces():
    text = "abcd" * ((langid.T.CHUNK_BYTES + 40) // 4)
    import pyarrow as pa

    (_, x), = langid.features(pa.array([text]))
    n = len(text)
    assert abs(float(x.sum()) - 1) < 1e-3 and np.count_nonzero(x) == 16 and abs(x.max() * (4 * n - 6) - n / 4) < 2


# op 8


def plain_lines(rows, percent=90, radius=None):
    def normal(line):
        return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", line.translate({c: c + 32 for c in range(65, 91)})).strip(" ")

    return [(d, i, normal(line)) for d, t in rows if t is not None for i, line in enumerate(t.split("\n"))]


def test_line_dedup(spark):
    rng = random.Random(8)
    common = prose(rng, 60)
    near = common.split()
    near[30] = near[30] + "x"
    rows = [(1, common + "\n" + prose(rng, 20)), (2, "head\n" + common.upper() + "!\n"), (3, " ".join(near)), (4, "short line\nshort line"), (5, None), (6, ""), (2, "head\n" + common.upper() + "!\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1))
    got = line_dedup.repeated_lines(df, min_words=5).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.n_lines, r.removed) for r in got}
    assert by[1] == (2, []) and by[2] == (3, [1]) and by[4] == (2, []) and by[5] == (0, []) and by[6] == (1, [])
    cleaned = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(df).collect()}
    assert cleaned[2] == "head\n" and cleaned[5] is None and cleaned[1] == rows[0][1]
    assert line_dedup.repeated_lines(df.limit(0)).count() == 0


def test_short_lines_odd_rows_and_long_texts(spark, odd, none):
    rows = [(1, "short line\nshort  LINE.\n\n--\n--"), (2, "x\n" + "long " * 60000), (3, "long " * 60000 + "tail"), (None, "x"), (None, "short line")]
    got = {(r.doc_id, r.n_lines): r.removed for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))).collect()}
    # null ids come first, and keep theirs; lines without a word are no lines to repeat
    assert got[(1, 5)] == [0, 1] and got[(2, 2)] == [0] and got[(3, 1)] == [0]
    assert line_dedup.repeated_lines(odd).count() == len(ODD) and line_dedup.repeated_lines(none).count() == 0
    kept = line_dedup.without_repeated_lines(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_packed_order_is_the_full_order():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(0, 200))
        line, level = np.sort(rng.integers(0, 9, n)), rng.integers(0, 40, n)
        pair = rng.integers(0, 1 << 63, n).astype(np.uint64)
        pair[rng.random(n) < 0.3] = 7
        a, b = line_dedup._by_line_and_level(line, level, pair), np.lexsort((pair, level, line))
        assert (line[a] == line[b]).all() and (level[a] == level[b]).all() and (pair[a] == pair[b]).all()


def test_line_exact_groups_against_brute_force(spark):
    rng = random.Random(9)
    pool = [prose(rng, 8, 1000) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else prose(rng, 9, 10**6) for _ in range(6))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, want = {}, {}
    for d, i, line in plain_lines(rows):
        if line in seen:
            want.setdefault(d, []).append(i)
        seen.setdefault(line, (d, i))
    assert {r.doc_id: r.removed for r in line_dedup.repeated_lines(df).collect() if r.n_removed} == want


def test_line_fuzzy_pairs_against_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for n in [10, 11, 14, 19, 20, 25, 29, 30, 40, 47, 80, 130] * 4:
        line = prose(rng, n, rng.choice([3, 40, 3000])).split()
        other = list(line)
        for k in range(n // 10 + rng.randrange(2)):
            at = rng.randrange(len(other)) if rng.random() < 0.5 else (5 + 10 * k) % len(other)
            other[at : at + rng.randrange(2)] = [f"new{'abcdefghijklmnop'[k]}"] * rng.randrange(2)
        rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(other))]
    split = [(d, text.split(" ")) for d, text in rows]
    group = {d: d for d, _ in rows}
    for d, a in split:
        for e, b in split:
            if d < e and line_dedup.edits_within(a, b, max(len(a), len(b)) // 10):
                old, new = max(group[d], group[e]), min(group[d], group[e])
                group = {k: new if v == old else v for k, v in group.items()}
    want = {d for d, g in group.items() if g != d}
    assert len(want) > 20
    assert {r.doc_id for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_removed} == want


def test_word_levels_count_every_text(spark):
    docs = spark.createDataFrame([(i, i, f"often w{i}\noften w{i}") for i in range(40)], "doc_id long, text_hash long, text string")
    levels = line_dedup.word_levels(line_dedup.line_prints(docs))
    # 80 of the one word, and two of each other one
    assert sorted(levels[levels > 0]) == [int(4 * np.log2(3))] * 40 + [int(4 * np.log2(81))]


def test_shared_blocks_of_the_same_lines_are_one(spark):
    rows = [(k, i) for k in range(5) for i in (1, 2)] + [(9, i) for i in (1, 2, 3, 3)] + [(10, 4), (11, 4), (11, 4)]
    found = line_dedup.shared_blocks(spark.createDataFrame(rows, "key long, id long")).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    assert sorted(r.ids for r in found.collect()) == [[1, 2], [1, 2, 3]]


def test_lines_whose_candidates_are_not_alike_are_still_compared(spark):
    rng = random.Random(8)
    for n in (30, 150):
        # copies with edits all over, near to some of the others only
        base = [f"w{i}" for i in range(n)]
        lines = []
        for _ in range(40):
            line = list(base)
            for i in rng.sample(range(n), rng.randrange(n // 10 + 1)):
                line[i] = rng.choice([f"x{rng.randrange(9)}", base[i], f"y{rng.randrange(9)}"])
            lines.append(line)
        rows = [(i, " ".join(x)) for i, x in enumerate(lines)]
        root = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                if line_dedup.edits_within(lines[i], lines[j], max(len(lines[i]), len(lines[j])) // 10):
                    a, b = root[i], root[j]
                    root = [min(a, b) if r in (a, b) else r for r in root]
        want = {i for i, r in enumerate(root) if r != i}
        got = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()
        assert {r.doc_id for r in got} == want


def test_first_pairs_are_few_and_outlast_the_edits():
    rng = np.random.default_rng(6)
    least = 0
    for _ in range(200):
        counts = rng.integers(2, 40, 4)
        line = np.repeat(np.arange(4), counts - 1)
        order = np.lexsort((rng.random(len(line)), line))
        need, edits = line_dedup.pairs_needed(50, 80)[counts], line_dedup.edits_allowed(50, 80)[counts]
        place = np.arange(len(line)) - np.searchsorted(line, line)
        taken = line_dedup.first_pairs(line, order, need, edits)
        for n in range(4):
            places = sorted(place[order][taken & (line == n)].tolist())
            # edits that reach all of the places, each a place and the next: as few as that takes
            hits, last = 0, -2
            for x in places:
                if x > last + 1 or last < 0:
                    hits, last = hits + 1, x
                else:
                    last = -2
            assert hits > edits[n] or len(places) >= min(need[n], counts[n] - 1)
            least += need[n] > len(places)
    assert least > 100


def test_blocks_count_their_lines_and_texts_theirs(spark):
    rows = [(k, i) for k in range(5) for i in (1, 2, 2)] + [(9, i) for i in (1, 2, 3, 3)] + [(10, 4), (10, 4)]
    found = line_dedup.shared_blocks(spark.createDataFrame(rows, "key long, id long"))
    assert sorted((r.id, r.size) for r in found.collect()) == [(1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]
    docs = spark.createDataFrame([(1, 5, "a\n\nb\n"), (2, 6, ""), (2, 6, "")], "doc_id long, text_hash long, text string")
    lines = line_dedup.line_prints(docs).where("line = -2").collect()
    assert sorted((r.doc_id, r.text_hash, r.id) for r in lines) == [(1, 5, 4), (2, 6, 1), (2, 6, 1)]


def test_edits_against_brute_force():
    rng = random.Random(13)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randrange(12))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.choice("abc")] * rng.randrange(2)
        d = distance(a, b)
        for most in range(6):
            assert line_dedup.edits_within(a, b, most) == (d <= most), (a, b, d, most)


def test_block_keys_find_all_within_radius(spark):
    rng = random.Random(10)
    rows = []
    for i in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(4)):
            b ^= 1 << bit
        rows.append((i, a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    df = spark.createDataFrame(rows, "i long, a long, b long")
    assert df.where(F.arrays_overlap(line_dedup.block_keys(F.col("a"), 5, 3), line_dedup.block_keys(F.col("b"), 5, 3))).count() == 200


# op 9


def plain_contamination(docs, items):
    out = {}
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            y = item.lower().split()
            k = min(5, len(y))
            if not y or len(words) < k:
                continue
            ys = [tuple(y[j : j + k]) for j in range(len(y) - k + 1)]
            best = None
            for s in range(max(1, len(words) - len(y) + 1)):
                x = words[s : s + len(y)]
                xs = [tuple(x[j : j + k]) for j in range(len(x) - k + 1)]
                shared = sum(min(xs.count(g), ys.count(g)) for g in set(ys))
                if shared * 175 >= (len(xs) + len(ys)) * 75:
                    sim = shared / (len(xs) + len(ys) - shared)
                    if best is None or sim > best[0]:
                        best = (sim, s)
            if best:
                out[d, i] = best
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.choice([3, 12, 40, 60]))) for i in range(12)] + [(50, "so so so so so so so so so"), (51, "")]
    docs = []
    for d in range(60):
        words = prose(rng, rng.randrange(5, 150)).split()
        if d % 2:
            passage = rng.choice(items[:12])[1].split()
            if rng.random() < 0.4 and len(passage) > 30:
                passage[rng.randrange(len(passage))] = "edited"
            at = rng.randrange(len(words))
            words[at:at] = passage
        docs.append((d, " ".join(words)))
    docs += [(100, None), (101, ""), (102, items[5][1] + " so so so so so so so so so so"), (103, items[3][1].upper())]
    got = decontaminate.contaminated_passages(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(0)).withColumn("h", F.lit(0)), spark.createDataFrame(items + [(None, "no id at all here")], "item_id long, text string")
    ).collect()
    want = plain_contamination(docs, items)
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in got} == {k: (round(a, 9), b) for k, (a, b) in want.items()}


def test_decontamination_truncated_passages(spark):
    rng = random.Random(22)
    items = [(i, prose(rng, rng.randrange(15, 60), 3000)) for i in range(40)]
    docs = []
    for i, text in items * 6:
        words = text.split()
        cut = round((len(words) - 4) * rng.uniform(0.08, 0.15))
        words = words[cut:] if rng.random() < 0.5 else words[: len(words) - cut]
        docs.append((len(docs), " ".join([prose(rng, 30, 3000), *words, prose(rng, 30, 3000)])))
    want = plain_contamination(docs, items)
    assert sum(0.75 <= a < 0.85 for a, _ in want.values()) > 50
    got = decontaminate.contaminated_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in got} == {k: (round(a, 9), b) for k, (a, b) in want.items()}


def test_decontamination_of_repeated_passages(spark):
    """A text that repeats an item thousands of times is as any other, and the first of its best windows counts."""
    item = [f"w{i}" for i in range(50)]
    words = ["x"] * 7 + item[:45] + ["y"] * 30 + item * 2000
    docs = [(1, " ".join(words)), (2, " ".join(words)), (2, " ".join(words)), (3, " ".join(item[:40] + ["z"] * 400)), (4, " ".join(item[:20] * 100))]
    got = decontaminate.contaminated_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.similarity, r.start_word) for r in got} == {(1, 1.0, 82), (2, 1.0, 82)} and len(got) == 2


def test_decontamination_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "some words stand here in a row"), (2, None)], "item_id long, text string")
    found = decontaminate.contaminated_passages(odd, items).collect()
    assert [(r.doc_id, r.item_id, r.similarity) for r in found] == [(None, 1, 1.0)]
    kept = decontaminate.without_contaminated(odd, items)
    assert kept.count() == len(ODD) - 1 and kept.columns == odd.columns
    assert decontaminate.contaminated_passages(none, items).count() == 0
    assert decontaminate.contaminated_passages(odd, items.limit(0)).count() == 0


# op 10


def test_tokens_equal_the_library(spark, odd):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    letters = list("abcXYZ019 \n\t\r.,;:!?'\"#$%&*()<>|-_éñßÖ÷ª中文  \x1c\x85") + ["'s", "  ", "\n\n", "<|endoftext|>"]
    rows = [(rng.randrange(-50, 50), "".join(rng.choice(letters) for _ in range(rng.randrange(40)))) for _ in range(300)] + [(r[0], r[1]) for r in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x"))
    path = tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    manifest = sstable.write_shards(df, sstable.scratch_path(spark, "tokens"), path, shards=5)
    got = sstable.read_shards(manifest).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    asked = spark.createDataFrame([(7,), (3,), (10**6,), (None,)], "doc_id long")
    found = sstable.lookup(manifest, asked).collect()
    expect = sorted((d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows if d in (7, 3))
    assert sorted((r.doc_id, list(r.ids)) for r in found) == expect
    assert sstable.token_shards(spark, df.limit(0), path).count() == 0


def test_tokens_odd_rows(spark, odd, none):
    wide = odd.withColumns({x: F.lit(1) for x in ("file", "low", "high", "ids", "bytes", "before", "documents")})
    got = sstable.token_shards(spark, wide, tokenizer_path()).collect()
    assert len(got) == len(ODD) and sum(r.doc_id is None for r in got) == 2 and min(r.n_tokens for r in got) == 1
    assert sstable.token_shards(spark, none, tokenizer_path()).count() == 0


def test_language_rows_odd(odd, none):
    kept = langid.accepted_rows(odd)
    assert kept.columns == odd.columns and kept.where("text IS NULL").count() <= 1
    assert langid.identify(odd).count() == len(ODD) and langid.accepted_rows(none).count() == 0


def test_shard_blocks_and_bloom():
    sink = io.BytesIO()
    writer = sstable.Writer(sink)
    keys = [sstable.key_of(None), *(sstable.key_of(i * 3 - 3000) for i in range(2000))]
    values = [np.arange(i % 50, dtype="<u4") * 2000 for i in range(len(keys))]
    for k, v in zip(keys, values, strict=True):
        writer.add(k, v.tobytes())
    size = writer.close()[2]
    reader = sstable.Reader(io.BytesIO(sink.getvalue()), size)
    assert [k for k, _ in reader] == keys and [sstable.id_of(k) for k in keys][:2] == [None, -3000]
    assert all(reader.get(k) == [v.tobytes()] for k, v in list(zip(keys, values, strict=True))[::97])
    absent = [sstable.key_of(i * 3 - 2999) for i in range(2000)]
    assert sum(map(reader.may_hold, absent)) < 60 and all(reader.get(k) == [] for k in absent[::97])
