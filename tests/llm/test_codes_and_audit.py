"""Byte-pair encoding, vector codes and the filter audit against plain versions and on odd rows."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from rangeloom.llm import bpe, filter_audit, vector_codes

ODD = [(None, None, None), (1, "", "a"), (2, " \n\t ", None), (3, "word", "a"), (3, "word", "a"), (4, "x " * 60000, "b"), (5, None, "b"), (None, "word", None), (6, "word", "")]
SCHEMA = "doc_id long, text string, lang string, ids string, h string, text2 string, mask string, n string, part string, label string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *"abcdefg") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# op 11


def bpe_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def odd_texts(rng, n):
    signs = ["a", "B", "'", "s", " ", "\n", "é", "Σ", "1", "!", "<|endoftext|>", "́", " ", "　", "中", "😀", "ß", "\x85", "\x1c", "​"]
    pick = lambda: chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x3000, 0xD800), rng.randrange(0xE000, 0x10FFFF)]))
    return ["".join(rng.choice([rng.choice(signs), pick()]) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = [None, "", " \n\t", "don't I'LL we'RE !!'s '''d", "a<|startoftext|>b <|endoftext|><|endoftext|", "<|ENDOFTEXT|> x", "ΟΔΟΣ ΣΣ", "İstanbul ǅ ß", "ﬁ ﷺ", "x" * 3000, "ab" * 2000 + "?!" * 999, "of.the, THE"]
    texts += odd_texts(rng, 1500) + ["".join(rng.choice("abcdeth.,") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    library = Tokenizer.from_file(bpe_path())
    for memo in (bpe.MEMO, 50):
        codec = bpe.Codec(bpe_path(), memo)
        for _ in range(2):
            at = 0
            for row, ids in codec.encode(pa.array(texts, pa.large_string())):
                assert row == at
                for got, text in zip(ids.to_pylist(), codec.decode(ids).to_pylist(), strict=True):
                    wanted = library.encode(texts[at] or "", add_special_tokens=False).ids
                    assert got == wanted, texts[at]
                    assert text == library.decode(wanted, skip_special_tokens=False)
                    at += 1
            assert at == len(texts)


def test_forced_boundaries():
    codec = bpe.Codec(bpe_path())
    assert not codec.forced(*b"th") and codec.forced(*b"a ") and codec.forced(*b" a")
    pairs = [(a, b) for a in range(256) for b in range(256) if codec.forced(a, b)]
    # no token holds a forced pair, and every other pair stands in some token
    inside = {tuple(raw[i : i + 2]) for t in codec._vocab for raw in [t.removesuffix("</w>").translate(codec._bytes).encode("latin-1")] for i in range(len(raw) - 1)}
    assert inside.isdisjoint(pairs) and len(inside) + len(pairs) == 65536
    # fragments are cut at every forced boundary and nowhere else
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(400))
    ends = codec.fragments(data, np.array([100, 400])).tolist()
    assert ends == sorted({100, 400} | {i for i in range(1, 400) if codec.forced(data[i - 1], data[i])})


def test_decode_leaves_unknown_ids_out():
    codec = bpe.Codec(bpe_path())
    lists = pa.array([[0, 99999999, 1], [], [-1], [49407]], pa.large_list(pa.int32()))
    assert codec.decode(lists).to_pylist() == ["! \"", "", "", "<|endoftext|>"]


def test_bpe_odd_rows(odd, none):
    rows = bpe.digests(bpe.encode_documents(odd, bpe_path())).collect()
    assert len(rows) == len(ODD) and sorted(r.n_tokens for r in rows) == [0, 0, 0, 0, 1, 1, 1, 1, 60000]
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r.ids_sha256 == r.decoded_sha256 == nothing for r in rows if r.n_tokens == 0)
    assert bpe.encode_documents(none, bpe_path()).collect() == []
    with pytest.raises(ValueError):
        import public_tokenizers

        bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))


# op 12


def plain_codes(rows, parts=16, entries=64, rounds=2):
    rows = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in rows), default=0) // parts)
    limit = vector_codes.LARGEST
    whole = [(i, [min(max(math.floor(256 * x), -limit), limit) for x in v] + [0] * (parts * width - len(v)), lab) for i, v, lab in rows]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in whole[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            given = [(nearest(p, cut(v, p))[1], cut(v, p)) for _, v, _ in whole]
            new = []
            for e, old in enumerate(books[p]):
                mine = [x for k, x in given if k == e]
                new.append([sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else old)
            books[p] = new
    out = []
    for i, v, lab in whole:
        found = [nearest(p, cut(v, p)) for p in range(parts)]
        out.append((i, [e for _, e in found], sum(d for d, _ in found), lab))
    return out, books


@pytest.mark.parametrize("scale", [1.0, 300000.0])
def test_vector_codes_against_plain_version(spark, scale):
    rng = random.Random(2)
    centres = [[rng.gauss(0, scale) for _ in range(32)] for _ in range(6)]
    rows = [(i, [rng.gauss(x, scale / 5) for x in rng.choice(centres)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(400 + i, rows[3][1], 1) for i in range(60)] + [(500, None, 1), (501, [1.0] * 31 + [None], 1), (502, [math.nan] * 32, 2), (503, [math.inf] * 32, 2), (504, [0.0] * 32, 7)]
    made = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    wanted, books = plain_codes(rows)
    assert made.codebooks.tolist() == books
    assert sorted((r.vec_id, r.codes, r.error) for r in made.rows.collect()) == [(i, c, e) for i, c, e, _ in wanted]
    sums = {}
    for _, _, e, lab in wanted:
        sums[lab] = sums.get(lab, 0) + e
    by_id = {i: (c, e, lab) for i, c, e, lab in wanted}
    for r in vector_codes.digests(made).collect():
        c, e, lab = by_id[r.vec_id]
        assert (r.code, r.error, r.label_error) == ("".join(f"{x:02x}" for x in c), e, sums[lab])
    back = {r.vec_id: r.v for r in vector_codes.decompress(made).collect()}
    assert back[504] == [x for p, k in enumerate(by_id[504][0]) for x in books[p][k]]


def test_bounds_give_the_nearest_and_spare_scans():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (20, 4))
    x = centres[rng.integers(0, 20, 3000)] + rng.integers(-40, 40, (3000, 4))
    history, known, scanned = [centres + 10], None, []
    for _ in range(5):
        known, error, n = vector_codes.assign(x, history, known)
        far = ((x[:, None] - history[-1]) ** 2).sum(2)
        assert (known.code == far.argmin(1)).all() and (error == far.min(1)).all()
        scanned.append(n)
        # there and back again: the sum of the moves is near nothing, the moves are not
        history.append(history[0] + (900 if len(history) % 2 else 2))
    # rows whose bound dates from the first round need no scan when the entries are back
    assert scanned[0] == 3000 and 0 < scanned[1] < 3000 and scanned[2] <= scanned[1] and scanned[4] <= scanned[1]


def test_vector_codes_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, v string, code string, low string, entry int, error string"
    assert vector_codes.digests(vector_codes.compress(spark.createDataFrame([], schema))).collect() == []
    rows = [(None, [1.0, 2.0], None), (1, [0.5], 3), (1, [0.5], 3), (2, [], None), (3, None, 1), (4, [0.25] * 17, 3)]
    made = vector_codes.compress(spark.createDataFrame([(*r, "a", "b", "c", 1, "d") for r in rows], schema))
    assert made.codebooks.shape == (16, 5, 2)
    got = vector_codes.digests(made).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.error, r.label_error) for r in got) == [(False, 1, 0, 0), (False, 1, 0, 0), (False, 2, 0, 0), (False, 4, 0, 0), (True, None, 0, 0)]
    alone = vector_codes.compress(spark.createDataFrame([(9, [1e30, -1e30], 1)], "vec_id long, embedding array<float>, label int"))
    assert alone.rows.first().error == 0 and alone.codebooks[0].tolist() == [[vector_codes.LARGEST]]


# op 13


def plain_fails(rows):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, part in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        tests = [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            any(c in "#$%&*|" for c in text), i is not None and first[text] < i,
        ]
        yield i, part or "", "".join(f for f, t in zip("ABCDE", tests, strict=True) if t)


def plain_audit(rows, labels):
    out = {}
    fails = list(plain_fails(rows))
    for part in {p for _, p, _ in fails}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            alive = [(i, f) for i, p, f in fails if p == part]
            gone = []
            for step, name in enumerate(order, 1):
                removed = [x for x in alive if name in x[1]]
                redundant = sum(name in f for _, f in gone)
                alive = [x for x in alive if name not in x[1]]
                gone += removed
                shapley[name] += len(removed)
                lost = [sum((i, kind) in labels for i, _ in removed) for kind in ("good", "toxic")]
                out[part, order, step] = [len(alive), len(removed), redundant, sum(f == name for _, p, f in fails if p == part), *lost]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audit_rows(rng, n):
    texts = [" ".join(rng.choice(["alpha", "Beta", "GAMMA", "d#", "e", "f%"] + [f"w{k}" for k in range(rng.choice([5, 400]))]) for _ in range(rng.choice([3, 90, 140]))) for _ in range(n // 2)]
    return [(rng.randrange(10**6), rng.choice(texts), rng.choice(["a", "b", None])) for _ in range(n)]


def test_filter_audit_against_plain_version(spark):
    rng = random.Random(7)
    rows = audit_rows(rng, 400)
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i, _, _ in rows[:200]] + [(rows[0][0], None, 1), (10**7, 1, 1)]
    said = {(i, k) for i, q, t in labels for k, v in (("good", q), ("toxic", t)) if v == 1}
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    wanted = plain_audit(rows, said)
    for options in ({}, {"broadcast_blocks": 0}, {"blocks": 1}):
        got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(docs, marks, **options).collect()}
        assert got == wanted


def test_sketch_clears_only_unique_texts(spark):
    rng = random.Random(8)
    texts = [f"text {i}" for i in range(3000)] + ["copy one"] * 500 + ["copy two"] * 2
    keys = spark.createDataFrame([(t,) for t in texts], "text string").select("text", *filter_audit._keys(filter_audit.F.col("text")))
    rng.shuffle(texts)
    blocks = len(texts) * filter_audit.SLOTS // 64
    sketch = filter_audit.counting_sketch(keys, blocks)
    for small in (True, False):
        found = filter_audit.with_possible(keys, sketch, blocks, small, "left").where("possible").select("text").collect()
        assert sum(r.text.startswith("copy") for r in found) == 502 and len(found) - 502 < 150


def test_filter_audit_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(odd, labels).collect()}
    assert got == plain_audit([r[:3] for r in ODD], {(1, "good"), (4, "toxic")})
    assert filter_audit.audit(none, labels).collect() == []
    assert filter_audit.audit(odd, labels.limit(0)).count() == 120 * 5 * 3
