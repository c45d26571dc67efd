"""The methods themselves against plain versions: hashes, transducer, matching, secrets, models, samples, stages."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import bpe, common, decontaminate, language_id, near_dup, neighbours, quality, secret_scan, substring_dedup, token_shards, toxicity
from loomgraph.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def thue_morse(n=10):
    t = "a"
    for _ in range(n):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


# hashes and what stands on them


def test_no_words_collide_by_construction(spark):
    from tokenizers import Tokenizer

    x, y = thue_morse()
    hashes = common.Runs(pa.array([x, y, x + "a", "a" * 20_000, "a" * 20_001])).hash
    assert len(set(hashes.tolist())) == 5
    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(1, f"{x} x"), (2, f"{y} x"), (3, f"{x} x")], "doc_id long, text string")
    want = [(d, zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())) for d, t in docs.collect()]
    assert sorted((r.doc_id, r.ids_crc32) for r in token_shards.token_shards(spark, docs, path).collect()) == want
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, k=2).collect()} == {1: 1, 2: 2, 3: 1}
    tail = " ".join(f"w{i}" for i in range(34))
    twins = spark.createDataFrame([(1, f"{x} {tail}"), (2, f"{y} {tail}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(twins, 35).collect()] == [0, 0]


def test_words_of_equal_hash_keep_their_own_ids():
    table, raw = common.IdTable(), np.frombuffer(b"onetwosix", np.uint8)
    start, end = np.array([0, 3, 6, 0]), np.array([3, 6, 9, 3])

    def make(at):
        return np.array([int(raw[start[i]]) for i in at], np.int32), np.ones(len(at), np.int64)

    for _ in range(2):
        flat, size = table.ids(raw, start, end, np.array([5, 5, 7, 5], np.uint64), make)
        assert flat.tolist() == [ord(c) for c in "otso"] and size.tolist() == [1] * 4


# tokenizers


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokenizers_on_all_documents(spark, name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(name))
    library.no_truncation()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    if name.startswith("word"):
        got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in QUERIES["op1_token_shards"](spark, SF).collect()}
        assert got == {d: (len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for d, x in ids.items()}
    else:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op2_bpe"](spark, SF).collect()}
        assert got == {d: (len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for d, x in ids.items()}


def test_new_words_go_to_the_library_many_at_once():
    from tokenizers import Tokenizer

    path, given = tokenizer_path("word_bpe_49k.json"), []
    library, encoder = Tokenizer.from_file(path), token_shards.WordEncoder(path)

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counted()
    names = [a + b + c for a in ("ra", "É", "\u00fcn", "Lo") for b in ("ti", "\u00e7o", "men", "sca") for c in ("d", "\u00e9", "ng", "Ra", "\u4e2d")]
    texts = [" ".join(w + tail for w in names) for tail in ("", ".", "$$$", ".###", "),")]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for least in (1, 0):  # words that came before don't go there again
        given.clear()
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == want
        assert least <= len(given) <= 8 * least


def test_one_encoder_serves_the_tasks_of_a_process():
    path = tokenizer_path("word_bpe_49k.json")
    assert token_shards._encoder(path) is token_shards._encoder(path)


def test_words_beside_marks_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = "\u0130 \u0958 \u09dc \u212a H\u0331 a\u0301 \u1112\u1161\u11ab \u03a3 \ufb01 \u01c5 1 \u0663 \u2026 \u0338 a\u00a0 a\u0085 x<|endoftext|> <|endoftext|> it's x' 's A.b $ \U00010e80".split(" ")
    texts = [w + tail for w in odd for tail in ("", ".", "$$", "='", "=\u0338", "'s.", "e!?", "<|endoftext|>")]
    encoder = token_shards.WordEncoder(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == want
    whole = " ".join(texts)
    assert [x.tolist() for x in encoder.encode(pa.array([whole, None, ""]))] == [library.encode(whole, add_special_tokens=False).ids, [], []]


def test_every_text_goes_through_a_transducer(monkeypatch):
    from tokenizers import Tokenizer

    path, made = tokenizer_path("byte_bpe_50k.json"), []

    class Counted(bpe.Transducer):
        def __init__(self, encoder):
            super().__init__(encoder)
            made.append(self)

    monkeypatch.setattr(bpe, "Transducer", Counted)
    monkeypatch.setattr(bpe, "CHUNK", 100)
    library, encoder = Tokenizer.from_file(path), bpe.Encoder(bpe.MergeTable(path))
    texts = ["plain prose of a few words", "odd  spaces \n here, it's  so", "prose " * 60, "x" * 900, "", None]
    got = [[i for part in parts for i in part.tolist()] for parts in encoder.encode_column(pa.array(texts))]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(made) >= 4 and sum(t.pushes for t in made) >= 1 + 1 + 4 + 9


def test_query_reads_in_chunks_and_lets_ids_go_early(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").join(QUERIES["op2_bpe"](spark, SF), "doc_id").collect()
    assert bpe.CHUNK <= 4096 and all(r.n_steps == max(1, -(-len(r.text or "") // bpe.CHUNK)) for r in rows)
    long = [r for r in rows if r.n_steps > 1]
    assert len(long) > len(rows) // 3
    for r in long:  # all but the last chunk's ids and what an open piece may hold back leave before the end
        assert r.n_early > 0 and r.n_tokens - r.n_early <= bpe.CHUNK + 1024
    assert sum(r.n_early for r in long) > sum(r.n_tokens for r in rows) / 3


def test_state_is_bounded_at_production_constants(spark, monkeypatch):
    from tokenizers import Tokenizer

    path, pushed, most = tokenizer_path("byte_bpe_50k.json"), [], [0]
    push, step = bpe.PieceTransducer.push, bpe.Encoder.step

    def counted_push(self, data):
        pushed.append(len(data))
        return push(self, data)

    def watched_step(self, streams, chunks, ends):
        out = step(self, streams, chunks, ends)
        most[0] = max([most[0], *(len(t.kept) + len(t.long.pending if t.long else b"") for t in streams)])
        return out

    monkeypatch.setattr(bpe.PieceTransducer, "push", counted_push)
    monkeypatch.setattr(bpe.Encoder, "step", watched_step)
    table = bpe.MergeTable(path)
    library, encoder, rnd = Tokenizer.from_file(path), bpe.Encoder(table), random.Random(8)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(200).collect()]
    texts += ["".join(rnd.choice("abcdefgh") for _ in range(60_000)), " " * 9_000 + "x", "é" * 7_000 + " and 5" + "7" * 5_000, "=-" * 20_000]
    got = [[i for part in parts for i in part.tolist()] for parts in encoder.encode_column(pa.array(texts))]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(pushed) >= 60 and max(pushed) <= 8 * bpe.CHUNK
    assert most[0] <= 2 * bpe.CHUNK + table.lookahead + 4096


def test_pushes_give_ids_before_the_end_and_keep_little():
    encoder = bpe.Encoder(bpe.MergeTable(tokenizer_path("byte_bpe_50k.json")))
    text = "some words that come one after the other, don't they?  " * 40
    t, out, most = bpe.Transducer(encoder), [], 0
    for i in range(0, len(text), 7):
        out += t.push(text[i : i + 7])
        most = max(most, len(t.kept))
    early = len(out)
    assert [*out, *t.end()] == encoder.encode(text) and early > 300 and most < 30


def test_lookahead_suffices_for_random_merge_lists(tmp_path):
    rnd = random.Random(12)
    for case in range(25):
        tokens, merges = list("abc"), []
        while len(merges) < rnd.randrange(3, 14):
            a, b = rnd.choice(tokens), rnd.choice(tokens)
            if a + b not in tokens and len(a + b) < 9:
                merges.append(f"{a} {b}")
                tokens.append(a + b)
        path = tmp_path / f"{case}.json"
        path.write_text(json.dumps({"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}, "added_tokens": []}))
        table = bpe.MergeTable(str(path))
        for _ in range(20):
            text = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 200))).encode()
            t, out = bpe.PieceTransducer(table, 1), []
            for i in range(0, len(text), 3):
                out += t.push(text[i : i + 3])
                assert len(t.pending) <= table.lookahead + 3 + max(map(len, tokens))
            assert [*out, *t.end()] == table.merge(text)


# searches


def test_decontamination_against_all_alignments(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(60)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 14)))) for i in range(12)]

    def changed(text, edits):
        t = list(text)
        for _ in range(edits):
            t[rnd.randrange(len(t))] = rnd.choice(["", "z", "zz", "q"])
        return "".join(t)

    docs = []
    for d in range(60):
        _, item = items[d % 12]
        docs.append((d, " ".join(rnd.choice(words) for _ in range(12)) + "  " + changed(item, rnd.randrange(0, 6)).upper() + "\n" + rnd.choice(words)))

    def least(pattern, text):
        last = list(range(len(pattern) + 1))
        best = last[-1]
        for c in text:
            now = [0]
            for i, p in enumerate(pattern, 1):
                now.append(min(last[i] + 1, now[-1] + 1, last[i - 1] + (p != c)))
            last, best = now, min(best, now[-1])
        return best

    norm = decontaminate.normalise
    want = {(d, i, k) for d, t in docs for i, item in items if (k := least(norm(item), norm(t))) <= int(0.05 * len(norm(item)))}
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 40):  # 40: many blocks
        got = decontaminate.contamination(*frames, block_chars=block).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want) > 10


def plain_base_spans(text):
    """The base spans by scanning characters, without regular expressions."""
    found, i = [], 0
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def after(i, chars):
        while i < len(text) and text[i] in chars:
            i += 1
        return i

    while i < len(text):
        for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if text[i : i + len(name)].lower() == name and text[i : i + len(name)].isascii():
                j = i + len(name)
                j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                j = after(j, " ")
                if text[j : j + 1] in (":", "=") and j < len(text):
                    j = after(j + 1, " ")
                    j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                    k = after(j, value)
                    if k > j:
                        if k - j >= 6:
                            found.append(("assign", i, k))
                        i = k - 1
                        break
        i += 1
    for kind, head, chars, size in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            k = after(i + len(head), chars) if text.startswith(head, i) else i
            if k > i + len(head):
                found += [(kind, i, k)] * (k - i >= size)
                i = k
            else:
                i += 1
    return sorted(found, key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))


def test_secret_spans_against_a_plain_scan(spark):
    rnd = random.Random(8)
    parts = ["password", "Secret", "api_key", "APIKEY", "token", "passwd", '"', "'", " ", " ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef" * 3, "x1", "hunter22", "é", "\n", "Zx9Qw8Er7Ty6"]
    docs = [(d, "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 30)))) for d in range(400)] + [(400, None)]
    for r in secret_scan.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        base = plain_base_spans(docs[r.doc_id][1] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("entropy")] == [s for s in text.split(",") if s] and len(spans) - len(base) == r.n_entropy


def test_neighbours_equal_brute_force_when_all_is_visited(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SLICE", 60)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (700, 4)).astype(float)  # very many ties among unlike vectors
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, n=5, every=50, target=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    real = np.flatnonzero(x.any(axis=1))
    recall = []
    for q in range(0, 700, 50):
        if not x[q].any():
            assert q not in got
            continue
        others = real[real != q]
        s = np.array([np.dot(x[q], x[o]) / np.sqrt(np.dot(x[q], x[q])) / np.sqrt(np.dot(x[o], x[o])) for o in others])
        best = sorted(zip(-s.round(9), others.tolist()))[:5]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        recall.append(np.mean([round(-a, 9) == round(b[2], 9) for (a, _), b in zip(best, mine)]))
    assert np.mean(recall) >= 0.9


def test_bundles_hold_each_class_where_queries_look():
    sizes = np.array([5, 0, 90, 7, 3, 250, 1])
    b = neighbours.Bundles(sizes, 40)
    for c, n in enumerate(sizes.tolist()):
        for cls in range(n):
            place = int(b.of_classes(np.array([c]), np.array([cls * 7919 + c]))[0])
            assert c in b.of_query([c])[place]


# models


def test_quality_parts_against_plain_ones(spark):
    texts = ["One two, two three!", "", "é 中 x x x", "a b a b a"]
    column = pa.array(texts)
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    bucket, h, of = quality._tokens(column)
    for i, row in enumerate(quality.pooled(column, vectors)):
        v = vectors[bucket[of[i] : of[i + 1]]].astype(float)
        if not len(v):
            assert not row.any()
            continue
        step = np.abs(np.diff(v, axis=0)).mean(axis=0) if len(v) > 1 else np.zeros(quality.DIM)
        assert np.allclose(row, [*v.mean(axis=0), *v.std(axis=0), *step, np.log1p(len(v))], atol=1e-4)
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for a, b in zip(of[:-1], of[1:]):
        for i in range(a, b):
            for j in range(max(a, i - quality.REACH), min(b, i + quality.REACH + 1)):
                if i != j:
                    for n in range(quality.NONZERO):
                        bits = int(h[j]) >> 6 * n
                        want[bucket[i], bits & quality.DIM - 1] += 1 - 2 * (bits >> 5 & 1)
    got = np.zeros_like(want)
    for r in quality.word_vector_sums(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).collect():
        got[r.bucket] = r[1:]
    assert (got == want).all()


def test_convolution_against_a_plain_one():
    net = language_id.Network(["de", "en", "fr"])
    x = np.random.default_rng(2).integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    pooled = []
    for w in x:
        row = []
        for width, table, bias in zip(language_id.WIDTHS, net.tables, net.bias):
            for f in range(language_id.FILTERS):
                row.append(max(0, max(sum(table[i, w[p + i], f] for i in range(width)) for p in range(len(w) - width + 1)) + bias[f]))
        pooled.append(row)
    z = np.array(pooled) @ net.out + net.out_bias
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(net.log_probabilities(x), want, atol=1e-3)
    net.tabulate()
    assert np.allclose(net.log_probabilities(x), want, atol=1e-3)


def test_toxicity_is_noisy_or_of_sentences():
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(0, 0.3, toxicity.BUCKETS), -1.0)
    texts = ["One two. Three four five! Six?", "", "no end", "a.b\nc"]
    bags = toxicity.Bags(pa.array(texts))
    p = model.sentences(bags)
    for i, text in enumerate(texts):
        own = []
        for sentence in re.split(r"[.!?\n\r]", text):
            if re.search(r"\w", sentence):
                b = toxicity.Bags(pa.array([sentence]))
                own.append(1 / (1 + np.exp(-(model.w[b.parts].sum() - 1.0))))
        assert np.isclose(model.documents(bags, p)[i], 1 - np.prod([1 - x for x in own]), atol=1e-5)


@pytest.mark.parametrize("text, letters", [("½ ² ① Ⅷ 12", False), ("x½", True), ("ʰ", True), ("_ -", False)])
def test_letters(text, letters):
    assert bool(language_id._LETTER.search(text)) == letters


def test_samples_are_bounded_and_reach_rare_languages(spark):
    many = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 9000).alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(i, f"rara avis {i}", "la") for i in range(100, 110)], "doc_id long, text string, lang string")
    docs = many.unionByName(rare)
    labels = spark.createDataFrame([(7, 1), (101, 0), (102, 0)], "doc_id long, quality int")
    rows = quality.training_sample(docs, labels, "quality", 500).collect()
    assert len(rows) == 500 and len({r.text for r in rows}) == 500
    small = quality.training_sample(docs, labels, "quality", 500, 2_000).collect()
    assert 0 < sum(len(r.text) for r in small) <= 2_000
    network = language_id.train_language_id(docs, most=200)
    assert network.languages == ["en", "la"]
    got = language_id.predict_language(rare, network).where("lang_pred = 'la'").count()
    assert got == 10


# many rows of one kind


def test_near_duplicates_of_very_many_empty_and_equal_texts(spark):
    docs = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, "").otherwise("the same few words").alias("text")).withColumnRenamed("id", "doc_id")
    got = near_dup.near_duplicates(docs, k=2)
    assert got.where("kept").count() == 20_001
    assert got.where("doc_id % 2 = 1 and component_id <> 1").count() == 0


# stages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, name string, h long"
ROWS = [(1, "alpha beta gamma delta epsilon zeta", "en", "s", 3, "r", "n", 1), (1, "alpha beta gamma delta epsilon zeta", "en", "s", 3, "r", "n", 1), (2, None, None, None, None, None, None, None),
        (None, "password = hunter22x", "en", "s", 1, "r", "n", 1), (3, "", "de", "s", 0, "r", "n", 1), (4, " \n ", "de", "s", 3, "r", "n", 1)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, name, stage):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = stage(spark, docs, SF)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0 and 0 < kept.count() <= len(ROWS)
    if name != "tokenize":
        assert kept.columns == docs.columns and empty.columns == docs.columns
    if name == "secrets":
        assert {r.text for r in kept.collect()} == {ROWS[0][1], None, "[SECRET]", "", " \n "}
    if name in ("near_dedup", "decontaminate"):
        assert kept.count() == len(ROWS)  # rows of one document stay together
