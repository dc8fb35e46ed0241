"""Each operator against a plain definition, and the odd inputs each must take."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from veilspark.llm import ann, html, licenses, media, mixing, neardup, packing, pii, quality, recompress
from veilspark.llm.words import mix, split_words, word_ids

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, z string, shared string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, ids=None):
    """Documents with columns that clash with names used inside."""
    rows = [(i, t, "en", f"s{i % 3}" if i is not None and i % 4 else None, None, "k", "z", "x") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, vocabulary=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randrange(1, 6))) for _ in range(vocabulary)]
    return [r.choice(words) for _ in range(n)]


ODD = [None, "", "   \n\t ", "one", "one", "é😀 " * 3, "A b C d E", "x" * 100_000, " ".join(prose(9, 4000))]


# ---- packing ----------------------------------------------------------------


def test_packing_places_every_token_once(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, "a  b", "a \n b", "tail ", " head", "<|endoftext|> x", "don't 12,34 ... !", *[" ".join(prose(s, 30 * s)) for s in range(1, 25)]]
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(table(spark, texts), path).collect()
    t = Tokenizer.from_file(path)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        pieces = sorted(by[i], key=lambda r: r.piece)
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == 1024 for r in pieces[1:]) and (len(ids) > 1024 or len(pieces) == 1)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 1024


def test_packing_is_near_the_bound():
    lengths = np.sort(np.random.default_rng(0).integers(1, 1025, 5000))[::-1]
    bins, _ = packing.sum_of_squares(lengths, 1024)
    assert bins.max() + 1 <= 1.03 * lengths.sum() / 1024 + 1
    assert np.bincount(bins, lengths).max() <= 1024


# ---- near duplicates ------------------------------------------------------------


def components_of(texts):
    def shingles(t):
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(words, r, share):
    return [("zz" + str(r.randrange(10**6))) if r.random() < share else w for w in words]


@pytest.mark.parametrize(("length", "copies"), [(40, 60), (200, 50), (900, 14)])
def test_near_duplicates_are_the_exact_components(spark, length, copies):
    r = random.Random(length)
    texts = list(ODD)
    for g in range(6):
        base = prose(g, length, 4000)
        texts += [" ".join(edited(base, r, r.choice([0, 0.01, 0.02, 0.04, 0.06]))) for _ in range(copies)]
    r.shuffle(texts)
    got = neardup.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()
    assert [(x.n_shingles, x.component_id, x.kept) for x in got] == [(n, c, c == i) for i, (n, c) in enumerate(components_of(texts))]


def test_near_duplicate_blocks(spark, monkeypatch):
    """Many members of one posting meet in pairs of blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    r = random.Random(3)
    texts = [" ".join(edited(prose(1, 120, 4000), r, 0.03)) for _ in range(120)]
    got = neardup.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()
    assert [(x.n_shingles, x.component_id) for x in got] == components_of(texts)


def test_near_duplicates_far_ends_of_a_group(spark, monkeypatch):
    """Copies that are near one another but often too far to link: many pairs fail, the links that hold are found."""
    r = random.Random(8)
    base = prose(2, 150, 4000)
    texts = [" ".join(edited(base, r, 0.045)) for _ in range(250)]
    got = neardup.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()
    assert [(x.n_shingles, x.component_id) for x in got] == components_of(texts)
    monkeypatch.setattr(neardup, "FEW", 0)
    again = neardup.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()
    assert again == got


def test_near_duplicates_with_repeated_and_null_ids(spark):
    a, b, c = (" ".join(prose(s, 60, 4000)) for s in range(3))
    texts, ids = [a, a, a + " x", b, b + " y", c, None, None, a], [5, 5, 7, 9, 9, None, None, 3, None]
    got = sorted((x.doc_id or -1, x.n_shingles, x.component_id or -1, x.kept) for x in neardup.near_duplicates(table(spark, texts, ids)).collect())
    assert got == sorted([(5, 56, 5, True), (5, 56, 5, True), (7, 57, 5, False), (9, 56, 9, True), (9, 57, 9, True), (-1, 56, -1, True), (-1, 0, -1, True), (3, 0, 3, True), (-1, 56, 5, False)])


# ---- substrings -------------------------------------------------------------------


def removed(texts, width):
    words = [WORDS.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = []
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        left = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return out


def test_substrings_match_the_definition(spark):
    r = random.Random(5)
    shared = [prose(s, r.randrange(40, 140), 2000) for s in range(6)]
    texts = list(ODD)
    for i in range(80):
        parts = [prose(100 + i, r.randrange(0, 90), r.choice([2, 3, 2000]))]
        for _ in range(r.randrange(3)):
            parts += [r.choice(shared)[r.randrange(20) :], prose(500 + r.randrange(9), r.randrange(0, 70), r.choice([1, 2, 2000]))]
        texts.append(r.choice([" ", "\n", "  "]).join(w for p in parts for w in p))
    texts += [" ".join(["t"] * 60), " ".join(["t"] * 1000), " ".join(["a", "b"] * 200), texts[20], texts[20]]
    got = recompress.substring_dedup(table(spark, texts)).orderBy("doc_id").collect()
    assert [(x.n_words, x.n_removed, x.kept_sha256) for x in got] == removed(texts, 50)


def test_substrings_with_repeated_and_null_ids(spark):
    a, b, c = (prose(s, 90, 4000) for s in (1, 2, 3))
    texts = [" ".join(x) for x in (a, a[:70] + b, a[:70] + b, c, b[:60] + c, a, c)]
    ids = [1, 4, 4, 2, 4, None, 9]
    got = sorted((x.doc_id or 0, x.n_words, x.n_removed, x.kept_sha256) for x in recompress.substring_dedup(table(spark, texts, ids)).collect())
    sha = lambda w: hashlib.sha256(" ".join(w).encode()).hexdigest()
    want = [(1, 90, 0, sha(a)), (4, 160, 70, sha(b)), (4, 160, 70, sha(b)), (2, 90, 0, sha(c)), (4, 150, 90, sha(b[:60])), (0, 90, 0, sha(a)), (9, 90, 90, sha([]))]
    assert got == sorted(want)


def test_anchors_depend_on_the_window_alone():
    r = np.random.default_rng(0)
    for _ in range(200):
        v = int(r.choice([1, 2, 3, 10, 1000]))
        core = mix(r.integers(0, v, 120).astype(np.uint64))
        x = np.concatenate([mix(r.integers(0, v, r.integers(0, 60)).astype(np.uint64)), core, mix(r.integers(0, v, r.integers(0, 60)).astype(np.uint64))])
        at = next(j for j in range(len(x) - 119) if (x[j : j + 120] == core).all())
        assert (recompress.anchors(core, 50) == recompress.anchors(x, 50)[at : at + 71]).all()
    assert len(recompress.anchors(word_ids(split_words("a b")), 50)) == 0


# ---- personal data ------------------------------------------------------------------


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(s))) % 10 == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(re.sub(r"\D", "", v)) <= 19 and luhn(re.sub(r"\D", "", v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub(r"\D", "", v)) <= 15),
}


def base_spans(text):
    out = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, (p, ok)) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if ok(m[0])]
    return [s for *_, s in sorted(out)]


def private_texts():
    r = random.Random(2)
    bits = ["a@b.c", "x.y+z@mail-1.example.com%q@e.f", "1.2.3.4.5", "256.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "😀", "é", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "\n", " ", "@", "..", "a@", "@b.c", "12", "-"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", ", "]) for _ in range(r.randrange(1, 40))) for _ in range(60)]
    return [*ODD, *texts, "1" * 30_000, "a" * 50_000 + "@b.c", "a.b@" + "c." * 9000 + "d", "+1" + " " * 30_000, "1 " * 20_000, "a@b.c " * 700, ".".join(["1"] * 9001)]


def test_private_spans_match_the_definition(spark):
    texts = private_texts()
    got = pii.find_private(table(spark, texts)).orderBy("doc_id").collect()
    for text, r in zip(texts, got):
        want = base_spans(text)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in KINDS]
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if s.split(":")[0] in KINDS] == want
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_redaction_leaves_no_base_span_and_no_clean_text_changed(spark):
    texts = private_texts()
    got = [r.text for r in pii.redact(table(spark, texts)).orderBy("doc_id").collect()]
    for before, after in zip(texts, got):
        if before is None:
            assert after is None
        elif not base_spans(before) and "token" not in before and not re.search(r"\d", before):
            assert after == before
    assert "@mail" not in got[texts.index(next(t for t in texts if t and "@mail" in t))]


def test_candidates_are_learned(spark):
    texts = ["the token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" here", "call phone 555-123-4567 now", "written by Mr. John Smith today", "born 2001-05-04 in spring", "order word 12345678 of", "see version 10.2.3-beta12x here"]
    spans = [r.spans for r in pii.find_private(table(spark, texts)).orderBy("doc_id").collect()]
    assert spans[0].startswith("secret:") and "number:11:23" in spans[1] and spans[2].startswith("name:") and spans[3:] == ["", "", ""]


def test_candidates_on_held_out_examples(spark):
    model = pii.trained(spark.sparkContext.applicationId)
    x, y = pii.featured(pii.examples(1300, seed=77))
    taken = 1 / (1 + np.exp(-(model.slope * model.logit(x) + model.offset))) >= model.threshold
    assert (taken & (y == 1)).sum() >= 0.97 * taken.sum() and (taken & (y == 1)).sum() >= 0.97 * (y == 1).sum()


def test_numbers_before_digits_and_short_secrets_are_proposed(spark):
    texts = ["call 555-123-4567 3pm", "SSN 123-45-6789 2nd page", "phone (555) 123-4567 24h", "call 555-123-4567 2", "ssn 2 123-45-6789 2", "account 1234 5678 9012", 'password = "hunter"', "secret: correcthorse", "mobile 555.123.4567."]
    want = ["555-123-4567", "123-45-6789", "(555) 123-4567", "555-123-4567", "123-45-6789", "1234 5678 9012", "hunter", "correcthorse", "555.123.4567"]
    cut = pii._scanned(table(spark, texts), pii.PROPOSED).orderBy("doc_id").collect()
    for r, w in zip(cut, want):
        assert w in [*r.v_number, *r.v_secret], (r.text, r.v_number, r.v_secret)
    left = [r.text for r in pii.redact(table(spark, texts[:5])).orderBy("doc_id").collect()]
    assert not [t for t in left if re.search("4567|6789", t)]


# ---- the others -----------------------------------------------------------------------


def test_mixing_takes_whole_epochs_and_keeps_to_its_budget(spark):
    r = random.Random(1)
    texts = [" ".join(["w"] * r.randrange(1, 40)) for _ in range(400)]
    rows = [(i, t, "en", "big" if i < 300 else r.choice(["s", "t", None]), 0, "k", "z", "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_sources(docs, entropy=0.98, repeats=3.0, block_docs=20).collect()
    size = {i: len(t.split()) for i, t in enumerate(texts)}
    taken = {}
    for x in out:
        taken.setdefault(x.source, {}).setdefault(x.epoch, []).append(x.doc_id)
    weight = {x.source: x.weight for x in out}
    assert abs(sum(weight.values()) - 1) < 1e-6
    entropy = -sum(w * np.log(w) for w in weight.values()) / np.log(len(weight))
    assert entropy >= 0.98 - 1e-6 or max(len(e) for e in taken.values()) <= 3
    for source, epochs in taken.items():
        own = {i for i, x in enumerate(rows) if x[3] == source}
        for e, ids in epochs.items():
            assert len(ids) == len(set(ids)) and set(ids) <= own
            if e < max(epochs):
                assert set(ids) == own
        assert set(epochs[0]) == own
    budget = sum(size[x.doc_id] for x in out) + 40 * len(weight)
    for source, epochs in taken.items():
        assert abs(sum(size[i] for ids in epochs.values() for i in ids) - weight[source] * budget) <= 40 * (len(weight) + 1)


def mixed(rows, goal, repeats, block_docs, places):
    """The same by its definition: rows are (doc_id, text, source), places are {(doc_id, epoch): (block hash, position)}."""
    total, own = {}, {}
    for i, text, source in rows:
        own.setdefault(source, []).append((i, len((text or "").split())))
    total = {s: sum(n for _, n in d) for s, d in own.items()}
    every = sum(total.values())
    weights = lambda a: {s: (t / every) ** a / sum((u / every) ** a for u in total.values()) for s, t in total.items()}
    entropy = lambda a: -sum(w * np.log(w) for w in weights(a).values()) / np.log(len(total))
    epochs_of = lambda a: max(weights(a)[s] / t for s, t in total.items()) / min(weights(a)[s] / t for s, t in total.items())

    def least(good):
        low, high = 0.0, 1.0
        if good(0.0):
            return 0.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if good(mid) else (mid, high)
        return high

    a = max(least(lambda a: entropy(a) <= goal), least(lambda a: epochs_of(a) <= repeats * (1 + 1e-9)))
    w = weights(a)
    budget = max(total[s] / w[s] for s in total)
    out = set()
    for s, docs in own.items():
        quota = max(int(budget * w[s] * (1 + 1e-9)), total[s])
        whole, rest = divmod(quota, total[s])
        out |= {(i, e) for i, _ in docs for e in range(whole)}
        blocks = -(-len(docs) // block_docs)
        used = 0
        for i, n in sorted(docs, key=lambda d: (places[d[0], whole][0] % blocks, places[d[0], whole][1])) if rest else []:
            used += n
            if used > rest:
                break
            out.add((i, whole))
    return out, w


@pytest.mark.parametrize(("goal", "repeats", "block_docs"), [(0.97, 2.0, 20), (0.9, 5.0, 7), (0.999, 4.0, 1000)])
def test_mixing_is_its_definition(spark, goal, repeats, block_docs):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randrange(0, 40)), r.choice("aaaaaaabbc")) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    grid = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("epoch"))
    grid = grid.select("doc_id", "epoch", F.xxhash64(F.lit(7), F.lit("block"), "epoch", F.col("doc_id").cast("string")).alias("b"), F.xxhash64(F.lit(7), "epoch", F.col("doc_id").cast("string")).alias("p"))
    expected, weights = mixed(rows, goal, repeats, block_docs, {(x.doc_id, x.epoch): (x.b, x.p) for x in grid.collect()})
    got = mixing.mix_sources(docs, entropy=goal, repeats=repeats, block_docs=block_docs).collect()
    assert len(got) == len({(x.doc_id, x.epoch) for x in got})
    assert {(x.doc_id, x.epoch) for x in got} == expected
    assert all(abs(x.weight - weights[x.source]) < 1e-6 for x in got)


def test_mixing_keeps_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "a b", "x", "mine", 0.5), (1, "a b", "x", "mine", 0.5), (None, "c", "x", "mine", 0.5), (None, "d e f", "y", "mine", 0.5), (2, None, None, "mine", 0.5)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, s string, weight double"), columns=["s", "weight"]).collect()
    assert {x.s for x in got} == {"mine"} and {x.weight_in for x in got} == {0.5}
    assert sorted((x.doc_id or 0, x.n_tokens) for x in got if x.epoch == 0) == [(0, 1), (0, 3), (1, 2), (1, 2), (2, 0)]


def test_mixing_many_equal_sources_lose_nothing(spark):
    rows = [(i, "w " * (1000 + i % 3), "en", f"s{i:05d}", 0, "k", "z", "x") for i in range(6000)]
    assert mixing.mix_sources(spark.createDataFrame(rows, DOCS)).select("doc_id").distinct().count() == 6000


def test_mixing_odd_tables(spark):
    assert mixing.mix_sources(table(spark, [])).count() == 0
    got = mixing.mix_sources(table(spark, ODD), columns=["text", "z"])
    assert {r.doc_id for r in got.collect()} == set(range(len(ODD)))
    assert mixing.mix_sources(table(spark, [None, ""])).count() == 2


def test_media_round_trip(spark):
    body = [" ".join(prose(s, 3000, 4000)) for s in range(3)]
    texts = [*ODD, *body, body[0], body[0] + " end", "start " + body[0], body[1][:9000] + body[2][5000:], "a" * 64, "é" * 32]
    got = media.media_columns(table(spark, texts)).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        raw = (t or "").encode()
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_bytes == len(media.wave(p)) and r.media_sha256 == hashlib.sha256(media.wave(p)).hexdigest() and r.feature == media.feature(p)


def test_chunks_are_shared_and_altered_ones_noticed(spark):
    body = " ".join(prose(1, 20_000, 4000))
    stored = media.store(table(spark, [body, "new words first " + body]))
    sizes = [sum(len(g["z"]) for g in r.gives) + len(r.own) for r in stored.orderBy("doc_id").collect()]
    assert sizes[1] < 0.2 * sizes[0]
    with pytest.raises(ValueError, match="digest"):
        media.rebuild([{"digest": media.digest(b"x"), "size": 1}], b"", media.digest(b""), {media.digest(b"x"): b"y"})
    with pytest.raises(ValueError, match="digest"):
        media.rebuild([{"digest": None, "size": 1}], b"y", media.digest(b"x"), {})
    assert media.rebuild([{"digest": None, "size": 1}], b"x", media.digest(b"x"), {}) == b"x"
    payload = media.payload_of(body)[1]
    assert b"".join(media.chunks(payload)) == payload and max(map(len, media.chunks(b"\0" * 200_000))) <= media.MOST


def test_quality_on_held_out_rows(spark):
    r = random.Random(7)
    texts, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        w = prose(i, r.randrange(20, 200), 400)
        texts.append(" ".join(w).capitalize() + "." if good else r.choice([" ".join(x + "***" for x in w), " ".join(w[:3] * 40), " ".join(w).upper() + "!!"]))
        labels.append((i, int(good), 0))
    docs = table(spark, texts)
    out = quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in out)
    held = [(x.predicted, labels[x.doc_id][1]) for x in out if x.held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_quality_odd_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.classify(table(spark, ODD), none).collect()
    assert len(out) == len(ODD) and all(x.score == 0.5 for x in out)
    x = np.random.default_rng(0).normal(size=(400, 3))
    model = quality.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float))
    assert ((model.score(x) >= 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.85  # only a pair can tell


def test_ann_recall_and_odd_vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 16)) * r.uniform(0.2, 2, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [float("inf")] + [1.0] * 15), (9006, [1.0])]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(table_, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for g in got:
        by.setdefault(g.query_id, []).append((g.rank, g.vec_id, g.score))
    hits = 0
    assert set(by) == set(range(0, 3000, 20))
    for q, found in by.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(3000), -s))[:20].tolist())
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len(best & {f[1] for f in found})
    assert hits >= 0.95 * 20 * len(by)


def test_ann_small_tables(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    few = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "vec_id long, embedding array<float>")
    got = ann.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4]


def test_ann_lone_vectors_find_k(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16))
    x = np.r_[centres.repeat(170, 0) + 0.01 * r.normal(size=(2040, 16)), r.normal(size=(60, 16))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table_ = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    graph = ann.Graph(x[[0, 2040, 2041, 170]], np.array([[1, 2, 3], [0, 2, 3], [0, 1, 3], [0, 1, 2]]), np.array([0]), 1.0)
    graph.points = np.c_[graph.points, np.zeros(4)]
    sizes = np.array([900, 1, 2, 900])
    lists = next(iter(ann._probe(graph, 1.24, 4, sizes, 84)(iter([pa.RecordBatch.from_pydict({"query_id": [2040], "q": [x[2040].tolist()]})]))))["list"].to_pylist()
    assert lists[0] == 1 and sizes[lists].sum() >= 84
    got = ann.nearest(table_, F.col("vec_id") >= 2040).groupBy("query_id").count().collect()
    assert len(got) == 60 and all(g["count"] == 20 for g in got)


PAGE = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>{0}</a></ul></nav><div class="ad">Buy {1}</div><article><h1>{2}</h1><p><b>{3}<br><p>x&amp;y {4}</article><div id=comments>hm {5}</div><footer>&copy; us {6}</footer>'


def test_pages(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(*[f"w{i}{j}" for j in range(7)])) for i in range(12)]
    rows += [(90, None, None), (91, "", ""), (92, "http://h0.org/x", "plain words only"), (93, "http://h0.org/y", "<div><p>Alpha beta gamma delta.<p>Second one.</div><div class=sidebar>no</div>"), (94, "http://z", "<p>" * 3000 + "deep"), (95, "x", "<")]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i].text == f"w{i}2 w{i}3 x&y w{i}4" and got[i].n_chars == len(got[i].text)
    assert got[90].text == got[91].text == "" and got[92].text == "plain words only" and got[93].text == "Alpha beta gamma delta. Second one." and got[94].text == "deep"


def test_template_is_counted_over_all_pages_of_a_layout(spark):
    page = '<html><body><div class="ad">Buy {0}</div><div class="{1}"><h2>{2}</h2>{3}<p>{4}</p></div></body></html>'
    copy = "".join(f"<p>Long paragraph number {j} of the one article that was copied.</p>" for j in range(8))
    rows = [(i, page.format(f"x{i}", "a", "Copied", copy, "Layout a says hello.")) for i in range(40)]  # copies that differ in the advert alone
    rows += [(100 + i, page.format(i, "a", f"Short {i}", f"<p>Only text of page {i} here.</p>", "Layout a says hello.")) for i in range(4)]
    rows += [(200 + i, page.format(i, "b", f"Other {i}", f"<p>Own words of page {i} there.</p>", "Layout b says goodbye.")) for i in range(4)]
    table_ = spark.createDataFrame([(i, f"http://h.org/{i}", h) for i, h in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(table_).collect()}
    copied = " ".join(f"Long paragraph number {j} of the one article that was copied." for j in range(8))
    assert all(got[i] == f"Copied {copied}" for i in range(40))
    assert all(got[100 + i] == f"Short {i} Only text of page {i} here." and got[200 + i] == f"Other {i} Own words of page {i} there." for i in range(4))


def test_deep_and_odd_pages(spark):
    deep = "<html><body>" + "<div>" * 5000 + "<script>var leak=1;</script><nav>menu</nav><p>real words of the page</p>" + "</div>" * 5000 + "<p>and after</p></body></html>"
    assert html.extract(deep) == "real words of the page and after"
    body = "".join(f"<p>Paragraph {i} of some running text that goes on for a while.</p>" for i in range(4))
    page = f'<body><article>{body}<div class="side effects"><p>Nausea and other effects of the drug.</p></div><section class="related work"><p>Earlier studies of the drug.</p></section><div class="related"><a href="/x">Other page</a></div><div class="comments"><p>First!</p></div></article></body>'
    text = html.extract(page)
    assert "Nausea" in text and "Earlier studies" in text and "Other page" not in text and "First!" not in text
    rows = [(i, "http://h.example/%d" % i, p) for i, p in enumerate([None, "", "   ", "no mark-up", "<p>", "</p></div>", "<article>&amp; &eacute;&#x1F600;</article>"])] + [(None, None, "<p>x</p>"), (3, "http://h.example/3", "no mark-up")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(x.n_chars == len(x.text) for x in got)
    by = {x.page_id: x.text for x in got}
    assert by[0] == by[1] == by[2] == by[4] == by[5] == "" and by[3] == "no mark-up" and by[6] == "& é😀" and by[None] == "x"
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_near_copies_keep_their_article(spark):
    """Pages of a host that are near copies of one another have no template inside of their article."""
    common = "".join(f"<p>Sentence {i} that all of the copies share with one another.</p>" for i in range(8))
    rows = [(i, f"http://c.example/{i}", f"<body><nav>menu</nav><article><h1>Title {i}</h1><p>A longer paragraph that only copy number {i} has, which makes it count as an article of its own here.</p>{common}</article></body>") for i in range(6)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(f"copy number {x.page_id} has" in x.text and x.text.endswith("Sentence 7 that all of the copies share with one another.") and "menu" not in x.text for x in got)


def test_licenses(spark):
    rows = [
        ("a/LICENSE", licenses.TEMPLATES[0][1]), ("a/x.py", "code\ncode"), ("a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"), ("a/b/c/z.py", ""), ("q/w.py", "the copyright owner sleeps"), ("q/n.py", None), (None, "x"), ("a/b/c/LICENSE", "Licensed under CC BY 4.0."),
    ]
    got = {(r.path): (r.license, r.origin, r.line) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/LICENSE"][:2] == ("MIT", "file") and got["a/x.py"][:2] == ("MIT", "inherited") and got["a/b/y.py"] == ("Apache-2.0", "header", 0)
    assert got["a/b/c/z.py"][:2] == ("CC-BY-4.0", "inherited") and got["q/w.py"][0] is None and got[None][0] is None and got["q/n.py"][0] is None


def test_real_notices_reach_their_licence(spark):
    import textwrap

    wrap = lambda t, mark, n: "\n".join(mark + x for x in textwrap.wrap(t, n))
    full = {k: t for k, t in licenses.MORE if "SPDX" not in t}
    rows = [("s/a", "All rights reserved.\nx", "Proprietary"), ("s/b", "int a;\n// Licensed under the MIT License.\nint b;", "MIT"), ("s/c", "MIT License\n\nwords of another kind", "MIT"), ("s/d", "# SPDX-License-Identifier: GPL-2.0-or-later\nx", "GPL-2.0")]
    for i, (mark, n) in enumerate([("# ", 70), (" * ", 76), ("// ", 60)]):
        rows += [(f"h{i}/{k}", f"/*\n{wrap(full[k], mark, n)}\n\nint main() {{}}\nfoo bar\n", k) for k in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "Apache-2.0", "MPL-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC")]
    mit = licenses.MORE[4][1]
    rows += [("m/LICENSE", "MIT License\n\nCopyright (c) 2020 Jo Doe\n\n" + "\n\n".join(wrap(p, "", 78) for p in mit.split(" The above ")), "MIT"), ("m/x.py", "x", "MIT")]
    rows += [("b/LICENSE", "Copyright (c) 2020, Jo Doe\nAll rights reserved.\n\n" + wrap(full["BSD-3-Clause"], "", 78), "BSD-3-Clause"), ("b/x.py", "x", "BSD-3-Clause"), ("n/x", "all the words about a license\nthat nobody reserved", None)]
    got = {r.path: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame([x[:2] for x in rows], "path string, text string")).collect()}
    assert {p: got[p][0] for p, _, _ in rows} == {p: k for p, _, k in rows}
    assert got["m/LICENSE"][1] == got["b/LICENSE"][1] == "file" and got["m/x.py"][1] == "inherited"


def test_notices_without_their_first_word(spark):
    """No word is asked for before lines are compared."""
    cut = [licenses.TEMPLATES[i][1].split(" ", 1)[1] for i in (1, 9, 17)]
    rows = [(i, f"def f():\n    # {t}\n    return 1", "en", "s") for i, t in enumerate(cut)]
    got = licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).orderBy("doc_id").collect()
    assert [(r.license, r.line) for r in got] == [("MIT", 1), ("BSD-3-Clause", 1), ("CC0-1.0", 1)]


def test_full_licence_file(spark):
    text = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + f"{licenses._MIT}\n\n{licenses._AS_IS}\n"
    got = {r.path: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame([("a/LICENSE", text), ("a/b/c.py", "x = 1"), ("d/c.py", "x = 1")], "path string, text string")).collect()}
    assert got == {"a/LICENSE": ("MIT", "file"), "a/b/c.py": ("MIT", "inherited"), "d/c.py": (None, None)}


def test_document_that_is_a_licence_licenses_its_directory(spark):
    rows = [(1, "Licensed under the Apache License,\nVersion 2.0.", "en", "s"), (2, "plain words", "en", "s"), (3, "plain words", "fr", "s"), (4, "# Licensed under CC BY 4.0.\nx = 1", "en", "s"), (5, "other words", "en", "t")]
    got = {r.doc_id: (r.license, r.origin, r.line) for r in licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {1: ("Apache-2.0", "file", None), 2: ("Apache-2.0", "inherited", None), 3: (None, None, None), 4: ("CC-BY-4.0", "header", 0), 5: (None, None, None)}


@pytest.mark.parametrize(
    "run",
    [
        lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")), neardup.near_duplicates, recompress.substring_dedup, pii.find_private, pii.redact, media.media_columns, licenses.scan_documents,
        lambda d: quality.score(d, quality.fit(np.empty((0, len(quality.FEATURES))), np.empty(0))),
    ],
)
def test_empty_tables(spark, run):
    assert run(table(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("run", "same"),
    [
        (lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")), ("ids_crc32",)), (media.media_columns, ("payload_sha256", "feature")), (pii.find_private, ("spans", "base_sha256")),
        (lambda d: quality.score(d, quality.fit(np.empty((0, len(quality.FEATURES))), np.empty(0))), ("score",)), (lambda d: mixing.mix_sources(d).where("epoch = 0"), ("n_tokens",)), (licenses.scan_documents, ("license",)),
    ],
)
def test_repeated_and_null_ids_keep_their_rows(spark, run, same):
    texts = ["mail a@b.cc now", "mail a@b.cc now", "other words", None, None, "more"]
    rows = run(table(spark, texts, [7, 7, 7, None, 7, None])).collect()
    assert len(rows) == len(texts)
    assert sum(r.doc_id is None for r in rows) == 2
    assert max(Counter(tuple(r[c] for c in same) for r in rows).values()) >= 2


def test_redaction_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "mail a@b.cc", "x", "v", "t", "r")], "doc_id long, text string, x_email string, v string, t string, row string")
    got = pii.redact(df)
    assert got.columns == df.columns and got.first().asDict() == {"doc_id": 1, "text": "mail [EMAIL]", "x_email": "x", "v": "v", "t": "t", "row": "r"}
    assert pii.redact(table(spark, [])).count() == 0


def test_pipeline_on_a_folder(spark, tmp_path):
    import corpus_pipeline

    texts = [" ".join(prose(i, 120, 4000)).capitalize() + "." for i in range(40)]
    texts += [texts[0], texts[1] + " more", texts[2] + " mail a@b.cc"]
    table(spark, texts).select("doc_id", "text", "lang", F.coalesce("source", F.lit("s")).alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(range(40))


def test_ann_lists_are_balanced():
    r = np.random.default_rng(6)
    x = np.r_[r.normal(size=(3000, 8)) * 0.01 + 1, r.normal(size=(1000, 8)), np.ones((500, 8))]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = ann._balanced(x, ann._kmeans(x, 20), 450, 500)
    near = (x @ c.T).argmax(1)
    for i in np.flatnonzero(np.bincount(near, minlength=len(c)) > 450):
        assert len(np.unique(x[near == i], axis=0)) == 1


def test_ann_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.5, 0.5]) for i in range(60)]
    got = ann.nearest(spark.createDataFrame(rows + rows[:7], "vec_id long, embedding array<float>"), F.col("vec_id") == 31).orderBy("rank").collect()
    assert [g.vec_id for g in got] == [i for i in range(1, 43, 2) if i != 31][:20]
