"""The join, decontamination, models and the pipeline against brute force and held-out labels."""

import collections
import itertools
import math
import pickle
import time
import zlib

import numpy as np
import pytest

from wikilake.llm import common, components, decontaminate, jaccard, lmscore, toxicity


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t, k, "z") for k, t in enumerate(texts)], "doc_id long, text string, n long, c string")


def near_copies(rng, n_groups=12, spread=6):
    words = [f"w{k}" for k in range(60)]
    texts = [None, "", " \n ", "one", "one", "ONE", "one two three", "one  two\tthree"]
    for _ in range(n_groups):
        base = list(rng.choice(words, int(rng.integers(5, 120))))
        for _ in range(int(rng.integers(1, spread))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(0, len(copy)))] = str(rng.choice(words))
            texts.append(" ".join(copy + list(rng.choice(words, int(rng.integers(0, 3))))))
    shared = " ".join(f"license{k}" for k in range(40))
    texts += [shared + " " + " ".join(rng.choice(words, int(rng.integers(3, 30)))) for _ in range(40)]
    return texts


def shingle_sets(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return sets


def brute_components(texts):
    sets = shingle_sets(texts)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [root(k) for k in range(len(sets))]


@pytest.mark.parametrize(("cell", "heavy"), [(512, 24), (4, 3)])
def test_join_equals_all_pairs(spark, monkeypatch, cell, heavy):
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    if cell < 512:
        monkeypatch.setattr(jaccard, "PIVOTS", 1)
        monkeypatch.setattr(jaccard, "DEALT", 2)
        monkeypatch.setattr(common, "HOT_ROWS", 2)
        monkeypatch.setattr(common, "HOT_KEYS", 1000)
    texts = near_copies(np.random.default_rng(cell))
    out = {r.doc_id: r for r in jaccard.joined(frame(spark, texts).repartition(3)).collect()}
    sizes, roots = brute_components(texts)
    assert [out[k].n_shingles for k in range(len(texts))] == sizes
    assert [out[k].component_id for k in range(len(texts))] == roots


def test_join_of_many_near_copies_in_cells(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(1, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate((np.delete(base, rng.integers(0, 300, 8)), rng.integers(1, 2**63, 8).astype(np.uint64)))) for _ in range(120)]
    sets += [np.unique(rng.integers(1, 2**63, 300).astype(np.uint64)) for _ in range(120)]
    links = jaccard.linked([jaccard.bitmap(x) for x in sets], np.array(list(map(len, sets))), None, sets)
    assert len(links) == 119 and all(max(p, q) < 120 for p, q in links)


@pytest.mark.parametrize("at_once", [1 << 18, 2])
def test_components(spark, monkeypatch, at_once):
    """At once and in rounds, with a hot vertex."""
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    pairs = [(1, 2), (2, 3), (9, 8), (8, 3), (4, 4), *((50, k) for k in range(40, 48)), (60, 61), (61, 60), (-5, 61)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = dict.fromkeys((1, 2, 3, 8, 9), 1) | dict.fromkeys((50, *range(40, 48)), 40) | dict.fromkeys((60, 61, -5), -5)
    assert got == want


@pytest.mark.parametrize("cell", [512, 6])
def test_link_counts(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    texts = near_copies(np.random.default_rng(3), n_groups=5)
    got = {r.doc_id: r.n_links for r in jaccard.link_counts(frame(spark, texts)).collect()}
    sets = shingle_sets(texts)
    want = {i: sum(1 for j, b in enumerate(sets) if i != j and a & b and 100 * len(a & b) >= 80 * len(a | b)) for i, a in enumerate(sets)}
    assert got == want


def test_join_of_rows_without_ids_and_with_repeated_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(None, a), (None, a + " x"), (5, a + " y"), (5, b), (7, b + " z"), (None, None), (9, "solo word")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.joined(df).collect()))
    assert got == sorted([(0, 36, 5), (0, 37, 5), (5, 37, 5), (5, 36, 5), (7, 37, 5), (0, 0, 0), (9, 1, 9)])


def test_join_empty(spark):
    assert jaccard.joined(frame(spark, []).limit(0)).count() == 0
    assert [r.component_id for r in jaccard.joined(frame(spark, [None, ""])).orderBy("doc_id").collect()] == [0, 1]


def test_decontamination(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(400)]
    items = [" ".join(rng.choice(words, n)) for n in (40, 25, 12, 6, 3)] + [None, ""]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(40)] + [None, ""]
    want = set()
    for k, item in enumerate(items[:5]):
        pad = list(rng.choice(words, 50))
        texts.append(" ".join(pad[:25] + item.upper().split() + pad[25:]))
        want.add((len(texts) - 1, k))
    swapped = items[0].split()
    for p in (4, 15, 22, 33):
        swapped[p] = "zzz"
    texts.append("start " + " ".join(swapped) + " end")
    want.add((len(texts) - 1, 0))
    bench = spark.createDataFrame([(k, t, "q") for k, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(frame(spark, texts).repartition(3), bench).collect()}
    assert set(got) == want
    swap = got[len(texts) - 1, 0]
    assert (swap.n_equal, swap.n_item, swap.begin, swap.end) == (36, 40, 1, 41)
    assert decontaminate.overlaps(frame(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.overlaps(frame(spark, texts).limit(0), bench).count() == 0


def test_short_items_with_changed_words(spark):
    items, texts, want = [], [], set()
    for n in range(1, 13):
        item = [f"i{n}x{k}" for k in range(n)]
        items.append(" ".join(item))
        lacks = [c for m in range(4) for c in itertools.combinations(range(n), m) if m < n]
        for lack in lacks:
            swapped = [f"other{k}" if k in lack else w for k, w in enumerate(item)]
            cut = swapped[1:] if 0 in lack else swapped  # a missing first word
            for text in (["a", *swapped, "b"], cut, swapped[: n - 1] if n - 1 in lack else swapped):
                if n - len(lack) >= 0.8 * n:
                    want.add((len(texts), n - 1, n - len(lack)))
                texts.append(" ".join(text))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_equal) for r in decontaminate.overlaps(frame(spark, texts), bench).collect()}
    assert got == want


def test_lm_base_is_exact_and_model_is_a_distribution(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'ab'[k % 2]}{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 60)))) for k in range(300)] + [None, "", "Never SEEN words"]
    docs = frame(spark, [*texts, texts[0]])
    train = frame(spark, texts[:200])
    out = lmscore.scored(docs, train).orderBy("doc_id").collect()
    counts = collections.Counter()
    tokens = [(t or "").encode().lower().split() + [None] for t in [*texts, texts[0]]]
    for t in tokens[:200]:
        counts.update(t)
    n, v = sum(counts.values()), len(counts)
    assert len(out) == len(tokens)
    for r, t in zip(out, tokens, strict=True):
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert sum(r.score for r in out[200:300]) > sum(r.base_score for r in out[200:300])


def test_lm_probabilities_sum_to_one():
    """Over all cells, and all classes of endings, after one history."""
    rng = np.random.default_rng(0)
    depth, rows = 10, 1 << 12
    prior, mass = lmscore.unigram_tree(rng.integers(0, 50, 1 << depth).astype(float), rng.integers(0, 5, 1 << depth).astype(float))
    lex = lmscore.Lexicon(0, 0, None, None, depth, prior, mass)
    w = rng.normal(size=rows * lmscore.ROW).astype(np.float32)
    before_h, before_t = rng.integers(1, 2**63, 2).astype(np.uint64), rng.integers(1, 2**63, 2).astype(np.uint64)
    total = 0.0
    for cell in range(1 << depth):
        h, tail = np.uint64((cell & 31) << 59), np.uint64((cell >> 5) << 59)
        got = lmscore.log_probabilities(lex, w, np.append(before_h, h), np.append(before_t, tail), np.array([0, 3]))
        assert lmscore.paths(np.array([h]), np.array([tail]), depth)[0] == cell
        total += math.exp(got[2])
    assert total == pytest.approx(1, abs=1e-4)
    flat = lmscore.log_probabilities(lex, np.zeros_like(w), np.append(before_h, h), np.append(before_t, tail), np.array([0, 3]))
    assert flat[2] == pytest.approx(mass[-1] - math.log(np.exp(mass).sum()), abs=1e-4)  # without weights: the cell's share


def brute_log10(lex, w, counts, words):
    """The score of one text, token by token, in plain Python."""
    out, level_bits = 0.0, lmscore.HALVINGS
    h, tail, at = lmscore.tokens(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words).encode())]))
    seen = lmscore.histories(h, tail, at)
    for t in range(len(h)):
        path = int(lmscore.paths(h[t : t + 1], tail[t : t + 1], lex.depth)[0])
        for step in range(lex.depth):
            level, k = divmod(step, level_bits)
            so_far = path >> (lex.depth - step)
            node = (1 << k) | (so_far & ((1 << k) - 1))
            z = float(lex.prior[(1 << step) | so_far])
            for f in lmscore.FEATURES[level]:
                prefix = np.array([path >> (lex.depth - level_bits * level)])
                z += float(w[lmscore._weights_at(seen[f][t : t + 1], f, level, prefix, np.array([[node]]), (len(w) // lmscore.ROW).bit_length() - 1)[0, 0]])
            right = path >> (lex.depth - step - 1) & 1
            out -= math.log1p(math.exp(-z if right else z))
        word = words[t] if t < len(words) else None
        out += math.log(counts[word] + 0.5) - lex.mass[path]
    return out / math.log(10)


def test_lm_score_equals_brute_force(spark, monkeypatch):
    kept = {}
    train = lmscore.train
    monkeypatch.setattr(lmscore, "train", lambda t, lex: kept.update(lex=lex, w=train(t, lex)) or kept["w"])
    monkeypatch.setattr(lmscore, "TOP", 40)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"v{int(x)}" for x in rng.zipf(1.5, 40)) for _ in range(80)]
    docs = [*texts[:5], "never seen w1x", ""]
    out = lmscore.scored(frame(spark, docs), frame(spark, texts)).orderBy("doc_id").collect()
    counts = collections.Counter(x for t in texts for x in [*t.split(), None])
    for r, t in zip(out, docs, strict=True):
        assert r.score == pytest.approx(brute_log10(kept["lex"], kept["w"], counts, t.split()), rel=1e-3)


def test_lm_learns_from_weights_that_were_sent():
    """Weights that came out of a pickle, as they do on executors, are learnt from as fast as others and end up the same."""
    rng = np.random.default_rng(5)
    depth, bits = 15, 12
    lex = lmscore.Lexicon(0, 0, None, None, depth, *lmscore.unigram_tree(rng.integers(0, 50, 1 << depth).astype(float), rng.integers(0, 5, 1 << depth).astype(float)))
    h, tail = rng.integers(1, 2**63, (2, 40_000)).astype(np.uint64)
    at = np.arange(0, 40_001, 400)
    old = np.zeros(lmscore.ROW << bits, np.float32)
    sent, lexed = pickle.loads(pickle.dumps((old, lex)))
    times, ends = {}, {}
    for _ in range(3):
        for name, lex_, w in (("own", lex, old), ("sent", lexed, sent)):
            w, power = w.copy(), np.ones_like(w)
            began = time.process_time()
            lmscore.learn(lex_, w, power, h, tail, at)
            times[name] = min(times.get(name, math.inf), time.process_time() - began)
            ends[name] = w, power
    assert ends["own"][0].any() and all(np.array_equal(x, y) for x, y in zip(ends["own"], ends["sent"], strict=True))
    assert times["sent"] < 2.5 * times["own"], times


def test_lm_scores_with_weights_of_half_the_size():
    """Weights of 16 bits give the scores of the weights they come from; sums over the features of a level fit."""
    rng = np.random.default_rng(6)
    depth = 15
    lex = lmscore.Lexicon(0, 0, None, None, depth, *lmscore.unigram_tree(rng.integers(0, 50, 1 << depth).astype(float), rng.integers(0, 5, 1 << depth).astype(float)))
    h, tail = rng.integers(1, 2**63, (2, 20_000)).astype(np.uint64)
    at = np.arange(0, 20_001, 400)
    for w in (rng.normal(0, 0.3, lmscore.ROW << 12), np.full(lmscore.ROW << 12, -2.5), np.zeros(lmscore.ROW << 12)):
        small, unit = lmscore.fixed_point(w.astype(np.float32))
        assert small.nbytes == 2 * len(w)
        want, got = lmscore.log_probabilities(lex, w.astype(np.float32), h, tail, at), lmscore.log_probabilities(lex, small, h, tail, at, unit)
        assert got == pytest.approx(want, rel=1e-3, abs=0.02)


def test_lm_weights_grow_beyond_a_million_tokens():
    assert [lmscore.rows_of(n) for n in (10**6, 2 * 10**6, 4 * 10**6, 8 * 10**6)] == [15, 16, 17, 18]
    assert {f for level in lmscore.FEATURES for f in level} == set(range(5))
    h, tail = np.arange(1, 9, dtype=np.uint64) << np.uint64(40), np.arange(8, dtype=np.uint64)
    third = lmscore.histories(h, tail, np.array([0, 8]))[3]
    assert len(set(third[3:].tolist())) == 5 and len(set(third[:3].tolist())) == 1  # the third last, or none


def test_lm_without_training(spark):
    out = lmscore.scored(frame(spark, ["a b", None]), frame(spark, []).limit(0)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.score) for r in out] == [(3, 0, 0.0), (1, 0, 0.0)]


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    rows, marks = [], []
    for k in range(500):
        t = list(rng.choice(words, int(rng.integers(10, 80))))
        bad = k % 5 == 0
        if bad:
            t.insert(int(rng.integers(0, len(t))), str(rng.choice(["zonkword", "zonkperson", "vile"])))
        rows.append((k, " ".join(t), "en", 1))
        marks.append((k, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    m = toxicity.fit(docs.where("doc_id < 350"), labels)
    ask = docs.drop("score").where("doc_id >= 350")
    got = {r.doc_id: r.score for r in toxicity.scored(ask, m).collect()}
    right = np.mean([(got[k] >= 0.7) == (k % 5 == 0) for k in got])
    assert len(got) == 150 and right > 0.97 and 0.3 <= m.thresholds["en"] <= 0.9
    odd = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "12 !", "xx"), (3, "12 !", "xx")], "doc_id long, text string, lang string")
    scores = [r.score for r in toxicity.scored(odd, m).collect()]
    assert len(set(scores)) == 1 and 0 <= scores[0] < 0.7
    assert toxicity.fit(docs, labels.limit(0)).flat and toxicity.scored(odd, toxicity.fit(docs.limit(0), labels)).count() == 4


def test_toxicity_gradients():
    """The training step lowers the loss on a small case."""
    texts = [np.array([k * 977 + j for j in range(5)], np.uint64) for k in range(40)]
    y = np.array([k % 2 for k in range(40)])
    m = toxicity.train(texts, y, epochs=8, batch=8)
    s = np.concatenate([toxicity.score(m, t, np.array([len(t)])) for t in texts])
    assert ((s >= 0.5) == (y == 1)).all()


def test_toxicity_learns_from_all_rows(spark, monkeypatch):
    """Weights, counts and thresholds of 5,200 toxic and 9,300 clean rows, by both ways of the join and in several tasks."""
    marks = [(k, 1, int(k < 5_200)) for k in range(14_500)]
    rows = [(k, f"w{k % 97} {'vile' if k < 5_200 else 'good'} w{k}", "en") for k in range(14_500)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    begun, cuts, begin, calibrate = [], [], toxicity._begin, toxicity.calibrate
    monkeypatch.setattr(toxicity, "_begin", lambda seen, *sizes: begun.append((seen.max(1), sizes[:2])) or begin(seen, *sizes))
    monkeypatch.setattr(toxicity, "calibrate", lambda counts: cuts.append(sum(n for *_, n in counts)) or calibrate(counts))
    for most, words in ((100_000, 6_000_000), (0, 10_000)):
        monkeypatch.setattr(toxicity, "SMALL", most)
        monkeypatch.setattr(toxicity, "TASK_WORDS", words)
        begun.clear(), cuts.clear()
        m = toxicity.fit(docs, labels)
        (seen, whole), (_, one), (_, two) = begun
        assert whole == (9_300, 5_200) == (one[0] + two[0], one[1] + two[1]) and cuts == [14_500]
        assert seen[1] >= 5_200 and seen[0] >= 9_300  # the words of all rows are counted
        got = {r.doc_id: r.score for r in toxicity.scored(docs, m).collect()}
        assert np.mean([(got[k] >= 0.7) == bool(bad) for k, _, bad in marks]) > 0.99 and 0.3 <= m.thresholds["en"] <= 0.9


def test_toxicity_rounds_leave_no_garbage_in_the_driver(spark, monkeypatch):
    given = []
    monkeypatch.setattr(toxicity, "give_back", lambda *session: given.append(session))
    monkeypatch.setattr(toxicity, "TASK_WORDS", 20)
    docs = spark.createDataFrame([(k, f"{'vile' if k % 2 else 'kind'} words {k}", "en") for k in range(40)], "doc_id long, text string, lang string")
    toxicity.trained(toxicity.labelled(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic")))
    assert len(given) == toxicity.EPOCHS and all(session for session in given)


def test_toxicity_changes_are_averaged():
    """Over the tasks that changed a row, whatever batches they come in."""
    import pyarrow as pa

    def told(chunk, task, rows, value):
        value = np.array(value, np.float32)
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([task]), pa.array([np.array(rows, np.int32).tobytes()]), pa.array([value.tobytes()])], ["chunk", "task", "rows", "value"])

    parts = [told(-1, 0, [0], [[2, 4, 6]]), told(-1, 1, [0], [[0, 0, 0]]), told(3, 0, [1, 9], [[1, 1], [2, 2]]), told(3, 1, [9], [[4, 0]])]
    out = [x for b in toxicity._averaged(iter(parts)) for x in b.to_pylist()]
    got = {(x["chunk"], r): list(v) for x in out for r, v in zip(np.frombuffer(x["rows"], np.int32), np.frombuffer(x["value"], np.float32).reshape(len(x["rows"]) // 4, -1), strict=True)}
    assert got == {(-1, 0): [1, 2, 3], (3, 1): [1, 1], (3, 9): [3, 1]}


def test_pipeline_decides(spark, tmp_path):
    import corpus_pipeline as C

    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [text(60) for _ in range(120)]
    for k in range(0, 100, 4):
        rows[k] += " zonk"
    item = text(30)
    rows += [text(50) + " mail a.b@c.example.com now", item + " " + text(20), rows[1], rows[3] + " tail", None]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "extra") for k, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, score string")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = C.run(spark, str(tmp_path))
    kept = {r.doc_id: r for r in out.collect()}
    toxic = {k for k in range(0, 100, 4)}
    assert set(kept) == set(range(len(rows))) - toxic - {121, 122, 123}
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and kept[124].n_tokens == 0
    from wikilake.llm import bpe

    assert "<email>" in "".join(bpe.load(bpe.tokenizer_path()).text(kept[120].ids)).replace(" ", "")
    stage = C.mask_personal_data(spark, docs, str(tmp_path)).where("doc_id = 120").first()
    assert stage.n_chars == len(stage.text) and "<EMAIL>" in stage.text


def test_pipeline_learns_from_all_labels(spark, tmp_path, monkeypatch):
    import corpus_pipeline as C

    rows = [(k, f"w{k % 97} {'vile' if k < 900 else 'good'}", "en", "s", 9) for k in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, 1, int(k < 900)) for k in range(10_000)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    begun, cuts, begin, calibrate = [], [], toxicity._begin, toxicity.calibrate
    monkeypatch.setattr(toxicity, "_begin", lambda seen, *sizes: begun.append(sizes[:2]) or begin(seen, *sizes))
    monkeypatch.setattr(toxicity, "calibrate", lambda counts: cuts.append(sum(n for *_, n in counts)) or calibrate(counts))
    kept = {r.doc_id for r in C.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert kept == set(range(900, 10_000)) and begun[0] == (9_100, 900) and cuts == [10_000]


def test_crc_of_python_and_spark_agree():
    assert zlib.crc32(b"12") % 3 == 0x4F5344CD % 3


@pytest.mark.parametrize("n", [8, 12, 16, 24, 40])
def test_decontamination_recall(spark, n):
    """Against the alignment of every pair of an item and a text, at substitution rates up to a quarter."""
    rng = np.random.default_rng(n)
    words = [f"w{k}" for k in range(3000)]
    items = [list(rng.choice(words, n)) for _ in range(12)]
    texts = []
    for rate in (0.0, 0.1, 0.2, 0.25):
        for item in items:
            for _ in range(3):
                copy = [str(rng.choice(words)) if rng.random() < rate else w for w in item]
                texts.append([*rng.choice(words, int(rng.integers(0, 30))), *copy, *rng.choice(words, int(rng.integers(0, 30)))])
    number = {w: k for k, w in enumerate(words)}
    as_array = lambda t: np.array([number[w] for w in t])
    want = set()
    for d, text in enumerate(map(as_array, texts)):
        for i, item in enumerate(map(as_array, items)):
            for shift in range(-n + 1, len(text)):
                equal, begin, end = decontaminate.measured(item, text, shift)
                if decontaminate.enough(equal, end - begin, n):
                    want.add((d, i))
    docs = frame(spark, [" ".join(t) for t in texts])
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 20


def test_toxicity_forward_pass_equals_brute_force():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 1, 2, 7, 30)]
    m = toxicity.train([rng.integers(0, 2**63, 6).astype(np.uint64) for _ in range(30)], np.arange(30) % 2, epochs=1)
    got = toxicity.score(m, np.concatenate(texts), np.array([len(t) for t in texts]))
    for t, s in zip(texts, got, strict=True):
        a, b, c = toxicity._rows(t)
        x = np.concatenate((m.word[a] + m.word[b] + m.stem[c], np.zeros((toxicity.PAD, toxicity.DIM), np.float32)))
        z = m.out_bias
        for f in range(toxicity.FILTERS * len(toxicity.WIDTHS)):
            i, k = divmod(f, toxicity.FILTERS)
            w = toxicity.WIDTHS[i]
            best = max(sum(float(x[p + j] @ m.conv[i][j][:, k]) for j in range(w)) for p in range(len(t) + 1))
            z += float(m.out[f]) * max(best + float(m.bias[f]), 0)
        assert s == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)


def test_a_large_filter_comes_in_parts(spark, monkeypatch):
    """A filter over BITS never reaches the driver by one collect, and its bits are those of the hashes."""
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    def refused(self):
        raise AssertionError("collected at once")

    rows = spark.range(3000).select(F.xxhash64("id").alias("h"))
    h = rows.toPandas()["h"].to_numpy().view(np.uint64)
    monkeypatch.setattr(type(rows), "collect", refused)
    assert issubclass(type(rows), DataFrame)
    bits = common.BITS + 1
    got = common.bitset(rows, "h", bits)
    assert common.has(got, h, bits).all()
    assert int(np.bitwise_count(got).sum()) == len(np.unique(h & np.uint64((1 << bits) - 1)))


def test_join_leaves_no_garbage_in_the_driver(spark, monkeypatch):
    """The driver is collected after the filter, the candidates, their bitmaps and their sets, and no filter outlives its use."""
    from pyspark import Broadcast

    given, gone = [], []
    destroy = Broadcast.destroy
    monkeypatch.setattr(jaccard, "give_back", lambda *session: given.append(session))
    monkeypatch.setattr(Broadcast, "destroy", lambda self, blocking=False: gone.append(self) or destroy(self, blocking))
    texts = near_copies(np.random.default_rng(5), 4)
    got = {r.doc_id: r.component_id for r in jaccard.joined(frame(spark, texts)).collect()}
    assert got == dict(enumerate(brute_components(texts)[1])) and len(gone) == 2
    assert len(given) >= 5 and all(session == (spark,) for session in given)


def test_the_jvm_gives_back_what_it_freed_beside_its_heap(spark, monkeypatch):
    report = common.trim_jvm(spark)
    assert report == "" or report.startswith("Trim native heap")
    trimmed = []
    monkeypatch.setattr(common, "trim_jvm", trimmed.append)
    common.give_back()
    assert not trimmed
    common.give_back(spark)
    assert trimmed == [spark]


def test_pipeline_join_begins_without_the_model_of_the_stage_before(spark, tmp_path, monkeypatch):
    import corpus_pipeline as C

    done, grouped = [], jaccard.grouped
    monkeypatch.setattr(C, "give_back", lambda *session: done.append(session))
    monkeypatch.setattr(jaccard, "grouped", lambda docs: done.append("grouped") or grouped(docs))
    docs = spark.createDataFrame([(k, "a b c d e f g", "en", "s", 13) for k in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in C.keep_one_of_near_copies(spark, docs, str(tmp_path)).collect()] == [0]
    assert done == [(spark,), "grouped"]
