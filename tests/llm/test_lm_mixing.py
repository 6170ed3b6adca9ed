"""The mixing language model: base columns against plain Python, mixing against a loop over single bits, held-out scores."""

import math

import brute
import numpy as np
import pyarrow as pa
from llm_edge import edge_rows
from pyspark.sql import functions as F

from guardlake.llm import lm_mixing, queries

BASE = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")


def base_of(df):
    return sorted(((*r[:5], round(r[5], 6)) for r in df.select(*BASE).collect()), key=repr)


def test_base_columns_of_odd_rows(edge, empty):
    got = lm_mixing.report(edge)
    assert base_of(got) == brute.lm_base([r[:2] for r in edge_rows()])
    assert got.filter("score > 0 OR isnan(score)").count() == 0
    assert lm_mixing.report(empty).count() == 0


def test_words_beyond_the_head_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(lm_mixing, "HEAD", 20)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert base_of(lm_mixing.report(docs)) == brute.lm_base([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(40) if brute.zlib.crc32(str(i).encode()) % 7 == 2]
    rows = lm_mixing.report(spark.createDataFrame([(i, "Some words here") for i in ids], "doc_id long, text string")).collect()
    assert len(rows) == len(ids) and {(r["n_known"], r["train_tokens"], r["base_score"]) for r in rows} == {(0, 0, 0.0)}
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_codes_are_complete_and_decode():
    for weights in ([5, 1, 1, 7, 2, 2, 9], [1, 1], [3], list(range(1, 300))):
        code = lm_mixing.huffman(weights)
        paths = [tuple(code["bit"][s:s + n]) for s, n in zip(code["start"], code["length"])]
        assert sum(2.0 ** -len(p) for p in paths) == 1
        assert len(set(paths)) == len(paths) and not any(a != b and b[:len(a)] == a for a in paths[:50] for b in paths)
        taken = {}
        for s, n in zip(code["start"], code["length"]):  # a node is always reached by the same bits
            for k in range(n):
                assert taken.setdefault(int(code["node"][s + k]), tuple(code["bit"][s:s + k])) == tuple(code["bit"][s:s + k])


def small_model(texts):
    """A model learned without Spark from few texts."""
    parts = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    counted = next(lm_mixing._word_counts(iter([parts])))
    words = pa.Table.from_batches([counted]).sort_by([("n", "descending"), ("word", "ascending")])
    head = words.column("word").combine_chunks().slice(0, 30)
    counts = words.column("n").to_numpy()[:30].astype(np.int64)
    model = lm_mixing.Model(head, counts, len(texts), lm_mixing.huffman([*counts.tolist(), len(texts), 40]), lm_mixing.huffman([1] * 257))
    model.tables = [np.zeros(1 << lm_mixing.WORD_BITS, np.uint32) for _ in range(2)]
    model.spelling = [np.zeros(1 << lm_mixing.BYTE_BITS, np.uint32) for _ in range(4)]
    rng = np.random.default_rng(1)
    for t in (*model.tables, *model.spelling):  # any counts will do
        t[:] = rng.integers(0, 9, len(t)) + (rng.integers(0, 9, len(t)) << 16)
    return model


def single_bits(model, mixer, text):
    """Cost of one text, one bit after the other."""
    words = brute.words(brute.folded(text))
    head = {w: i for i, w in enumerate(model.head.to_pylist())}
    symbols = [*[head.get(w, model.end + 1) for w in words], model.end]
    contexts = lm_mixing.word_contexts(np.array(symbols), np.array([0, len(symbols)]))
    own_hash = lm_mixing._spread(np.array([1], np.uint64) * np.uint64(0xA24BAED4963EE407))
    weights, cost, at = mixer.weights.astype(float), 0.0, 0
    cache = {}

    def level(n):
        return 0 if n == 0 else 1 if n < 4 else 2 if n < 32 else 3

    def looked_up(table, slot):
        return int(table[slot]) & 65535, int(table[slot]) >> 16

    while at < len(symbols):
        end = at + max(32, at // 8)
        for spelling in (False, True):
            moves, used = np.zeros_like(weights), np.zeros(len(weights))
            later = []
            for t in range(at, min(end, len(symbols))):
                s = symbols[t]
                bits = []
                if not spelling:
                    for k in range(model.code["start"][s], model.code["start"][s] + model.code["length"][s]):
                        mark, node, bit = model.code["mark"][k:k + 1], model.code["node"][k], int(model.code["bit"][k])
                        pairs = [looked_up(tab, lm_mixing._slot(c[t:t + 1], mark, lm_mixing.WORD_BITS)[0]) for tab, c in zip(model.tables, contexts)]
                        place = int(lm_mixing._slot(own_hash, mark, lm_mixing.CACHE_BITS)[0])
                        pairs.append(tuple(cache.get(place, [0, 0])))
                        later.append((place, bit))
                        gate = level(sum(pairs[0])) * 9 + min(level(sum(pairs[1])), 2) * 3 + min(level(sum(pairs[2])), 2)
                        bits.append((gate, [float(model.code["stretch"][node]), *[math.log((b + .4) / (a + .4)) for a, b in pairs]], bit))
                elif s == model.end + 1:
                    _, ones, slots = lm_mixing.Speller(model.letters).bits(pa.array([words[t]]))
                    for k, bit in enumerate(ones):
                        pairs = [looked_up(tab, x[k]) for tab, x in zip(model.spelling, slots)]
                        gate = lm_mixing.WORD_GATES + min(level(sum(pairs[2])), 2) * 3 + min(level(sum(pairs[3])), 2)
                        bits.append((gate, [math.log((b + .4) / (a + .4)) for a, b in pairs], int(bit)))
                for gate, inputs, bit in bits:
                    value = max(-lm_mixing.LIMIT, min(lm_mixing.LIMIT, float(np.dot(weights[gate], inputs))))
                    p = 1 / (1 + math.exp(-value))
                    refined = (p + float(mixer.map[gate * lm_mixing.BINS + int((value + lm_mixing.LIMIT) * 4)])) / 2
                    cost -= math.log2(refined if bit else 1 - refined)
                    moves[gate] += (bit - p) * np.array(inputs)
                    used[gate] += 1
            for place, bit in later:
                cache.setdefault(place, [0, 0])[bit] += 1
            pace = lm_mixing.RATE * np.minimum(1, 32 / np.maximum(used, 1))
            weights = np.clip(weights + pace[:, None] * moves, -2, 6)
        at = end
    return cost


def test_mixing_equals_single_bits():
    texts = ["the cat sat on the mat", "", "Zebra quux the the the cat", " ".join(f"w{i % 7} the cat" for i in range(200)), "the"]
    model, mixer = small_model(texts), lm_mixing.Mixer()
    cost, *_ = lm_mixing.mixed(model, mixer, pa.RecordBatch.from_pydict({"text": pa.array(texts)}), own=False)
    # each text has a place of its own in the cache, so it is compared as the first of its batch
    for text in texts:
        alone, *_ = lm_mixing.mixed(model, mixer, pa.RecordBatch.from_pydict({"text": pa.array([text])}), own=False)
        want = single_bits(model, mixer, text)
        assert abs(alone[0] - want) < 1e-3 * max(want, 1), text
    assert all(abs(a - single_bits(model, mixer, t)) < 0.02 * single_bits(model, mixer, t) + 1 for a, t in zip(cost, texts))


def test_words_have_chances_that_sum_to_one():
    model, mixer = small_model(["a b c d e f g h a a b"]), lm_mixing.Mixer()
    n = len(model.head) + 2
    total = 0.0
    for s in range(n):  # the first token of a text: walk its path by hand
        p = 1.0
        for k in range(model.code["start"][s], model.code["start"][s] + model.code["length"][s]):
            mark = model.code["mark"][k:k + 1]
            contexts = lm_mixing.word_contexts(np.array([s]), np.array([0, 1]))
            pairs = [divmod(int(t[lm_mixing._slot(c, mark, lm_mixing.WORD_BITS)[0]]), 65536)[::-1] for t, c in zip(model.tables, contexts)]
            inputs = [float(model.code["stretch"][model.code["node"][k]]), *[math.log((b + .4) / (a + .4)) for a, b in pairs], 0.0]
            one = 1 / (1 + math.exp(-0.3 * sum(inputs)))
            p *= one if model.code["bit"][k] else 1 - one
        total += p
    assert abs(total - 1) < 1e-9


def peak_mb(run):
    import tracemalloc
    tracemalloc.start()
    out = [batch.column("data")[0].as_py() for batch in run()]
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, most


def test_learning_takes_little_beside_its_tables(monkeypatch):
    """Counts of bits are the same for any slices, and their temporary arrays stay small: 34 and 8 MB of tables are the most."""
    from types import SimpleNamespace
    monkeypatch.setattr(lm_mixing, "_task", lambda: 0)
    rng = np.random.default_rng(3)
    words = pa.array([f"{w:x}" for w in rng.integers(0, 1 << 40, 50_000)])
    texts = pa.array([" ".join(f"w{w}" for w in rng.integers(0, 40, 120_000))])
    model = small_model([" ".join(f"w{i % 40}" for i in range(400))])
    runs = {"words": lambda: lm_mixing._spelling(model.letters)(iter([pa.RecordBatch.from_pydict({"word": words})])),
            "texts": lambda: lm_mixing._word_tables(SimpleNamespace(value=model))(iter([pa.RecordBatch.from_pydict({"text": texts})]))}
    got = {k: peak_mb(run) for k, run in runs.items()}
    assert got["words"][1] < 60 and got["texts"][1] < 100
    monkeypatch.setattr(lm_mixing, "TOKENS", 1 << 17)
    monkeypatch.setattr(lm_mixing, "SPELLED", 50_000)
    assert all(peak_mb(run)[0] == got[k][0] for k, run in runs.items())


def test_a_model_survives_its_packing():
    import pickle
    model = small_model(["a b c"])
    again = pickle.loads(pickle.dumps(model))
    assert all((again.code[k] == model.code[k]).all() for k in model.code)
    assert all((a == b).all() for a, b in zip(again.tables + again.spelling, model.tables + model.spelling))


def test_held_out_texts_score_better_than_the_base(spark):
    got = queries.op11_lm_mixing(spark, "/root/testdata/sf0.01").groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
    assert all(r["s"] > r["b"] for r in got)


def test_weights_are_fitted_on_every_training_document(spark, monkeypatch):
    """The learner counts the texts it is given: all of them, however many there are."""
    rows = spark.range(30_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    learned, met = lm_mixing._learned, spark.sparkContext.accumulator(0)

    def counting(shared):
        run = learned(shared)

        def learn(batches):
            def through():
                for batch in batches:
                    met.add(batch.num_rows)
                    yield batch
            return run(through())
        return learn

    monkeypatch.setattr(lm_mixing, "_learned", counting)
    lm_mixing.train(rows)
    assert met.value >= 30_000


def test_several_slices_look_their_words_up_together(monkeypatch):
    """A look-up hashes the whole head, so it is not done for every slice; slices and symbols stay as they were."""
    texts = pa.array([*[f"the w{i % 9} cat new{i}" for i in range(700)], "", None, "mat " * (lm_mixing.BYTES // 3), *["on the mat"] * 700])
    model, batch, calls = small_model([" ".join(f"w{i % 9} the cat" for i in range(90))]), pa.RecordBatch.from_pydict({"text": texts}), []
    plain = lm_mixing.pc.index_in

    def counting(*args, **more):
        calls.append(1)
        return plain(*args, **more)

    monkeypatch.setattr(lm_mixing, "_task", lambda: 0)
    monkeypatch.setattr(lm_mixing.pc, "index_in", counting)
    from types import SimpleNamespace
    list(lm_mixing._word_tables(SimpleNamespace(value=model))(iter([batch])))
    parts = list(lm_mixing.slices(iter([batch])))
    assert len(parts) > 5 and len(calls) == 2  # up to the long text, and after it
    for alone, (part, words) in zip(parts, model.slices(iter([batch])), strict=True):
        assert alone.equals(part)
        assert all(np.array_equal(a, b) for a, b in zip(model.symbols(*words), model.symbols(*model.words(alone.column("text")))))


def test_mixing_is_the_same_for_any_blocks(monkeypatch):
    texts = [" ".join(f"w{(i * j) % 11} the rare{i * j % 13}" for j in range(i % 40)) for i in range(150)]
    model, mixer = small_model(texts), lm_mixing.Mixer()
    part = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    for own in (False, True):
        got = []
        for block in (1 << 13, 50, 1):
            monkeypatch.setattr(lm_mixing, "BLOCK", block)
            cost, *_, weights, used, seen = lm_mixing.mixed(model, mixer, part, own)
            got.append((cost, weights, used, seen))
        assert all(np.allclose(a, b, rtol=1e-6) for other in got[1:] for a, b in zip(got[0], other))


def test_tables_carry_predictions_and_levels():
    counts = [(0, 0), (1, 0), (0, 1), (1, 1), (3, 1), (40, 2), (1023, 1023)]
    table = np.array([a + (b << 16) for a, b in counts], np.uint32)
    level = [0 if n == 0 else 1 if n < 4 else 2 if n < 32 else 3 for n in range(2047)]
    plain, own = lm_mixing.stretched(table, False), lm_mixing.stretched(table, True)
    for k, (a, b) in enumerate(counts):
        for got, zero, one in ((plain[k], a, b), (own[2 * k], max(a - 1, 0), b), (own[2 * k + 1], a, max(b - 1, 0))):
            x, tag = lm_mixing.untagged(np.array([got]))
            assert x[0] == (lm_mixing._LOG[one] - lm_mixing._LOG[zero] or lm_mixing.LEAST) and tag[0] == level[zero + one]
