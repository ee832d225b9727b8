"""The registered queries themselves: columns, folds, all rows, nulls, repeated ids, clashing columns, empty tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from wikilake.llm import queries

COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_decontaminate": ["doc_id", "item_id", "n_equal", "n_item", "begin", "end"],
    "op3_lm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op4_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op5_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op6_html_text": ["page_id", "url", "text", "n_chars"],
    "op7_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op9_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op11_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op12_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13_clusters": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op10_fingerprint": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


def write(spark, folder, docs, labels, bench, pages, turns, vectors):
    extra = "version string, c string, key string, n string, spans string, base string, hits string, score string, host string, main string"
    row = lambda r: (*r, *["x"] * 10)
    spark.createDataFrame(list(map(row, docs)), f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(map(row, labels)), f"doc_id long, quality int, toxic int, text string, {extra}").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(map(row, bench)), f"item_id long, text string, doc_id long, {extra}").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(map(row, pages)), f"page_id long, url string, html string, text string, {extra}").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(list(map(row, turns)), f"conv_id long, turn long, role string, text string, {extra}").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame(list(map(row, vectors)), f"vec_id long, embedding array<float>, label int, {extra}").write.parquet(f"{folder}/embeddings.parquet")


def others(rng, text):
    """Turns and vectors: nulls, ties, repeated rows, a MB-long text, wrong sizes."""
    turns = [(c, t, "user", text(5)) for c in range(30) for t in range(3)] + [(None, 0, "user", "x"), (40, None, None, None), (40, None, None, None), (41, 0, "a", "tie"), (41, 0, "b", "tie"), (42, 0, "user", text(200_000))]
    vectors = [(k, rng.normal(0, 1, 64).tolist(), 0) for k in range(60)] + [(None, [0.5] * 64, None), (60, None, 1), (61, [1.0] * 63, 1), (62, [None] * 64, 1), (3, [0.5] * 64, 1), (3, [0.5] * 64, 1)]
    return turns, vectors


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = [(k, text(40), "en", "s", 1) for k in range(150)]
    docs += [(150, None, "en", "s", 0), (151, "", None, None, None), (None, text(20), "en", "s", 1), (3, text(30), "en", "s", 1), docs[5], docs[5], (152, "mail a.b@c.example.com and 10.0.0.1", "en", "s", 1), (153, docs[7][1], "en", "s", 1), (154, text(200_000), None, "long", 1)]  # the last has over a MB
    labels = [(k, 1, int(k % 3 == 0), "t") for k in range(0, 150, 2)] + [(None, 1, 1, "t"), (4, None, None, None)]
    pages = [(k, f"http://h.org/{k}", f"<article><p>{text(20)}</p></article>", "t") for k in range(5)] + [(None, None, None, None), (0, "u", "<p>x", "t")]
    folder = str(tmp_path_factory.mktemp("made"))
    write(spark, folder, docs, labels, [(0, docs[9][1], 1), (None, None, None), (0, docs[9][1], 1)], pages, *others(rng, text))
    empty = str(tmp_path_factory.mktemp("none"))
    write(spark, empty, [], [], [], [], [], [])
    return folder, empty, docs, pages


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, made, name):
    folder, empty, docs, pages = made
    df = queries.QUERIES[name](spark, folder)
    rows = df.collect()
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    none = queries.QUERIES[name](spark, empty)
    assert none.columns == df.columns and none.count() == 0
    key = "page_id" if name == "op6_html_text" else "doc_id"
    if name == "op12_prefix_trie":
        [root] = [r for r in rows if r.depth == 0]
        assert (root.n_convs, root.parent_conv_id, root.conv_id) == (33, None, 0) and root.n_leaves == sum(r.n_children == 0 for r in rows)
        return
    if name == "op13_clusters":
        assert Counter(r.vec_id for r in rows) == Counter([*range(60), None, 3, 3]) and {r.inertia for r in rows} == {sum(r.distance for r in rows)}
        return
    if name == "op2_decontaminate":
        assert {(r.doc_id, r.item_id, r.n_equal) for r in rows} == {(9, 0, 40)}
        return
    table = pages if key == "page_id" else docs
    assert Counter(r[key] for r in rows) == Counter(r[0] for r in table)  # every row, also without or with a repeated key
    remainder = {"op1_toxicity": (3, 1), "op3_lm_score": (5, 1), "op9_language": (5, 0)}.get(name)
    if remainder:
        n, k = remainder
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k) for r in rows if r.doc_id is not None)
    if name == "op1_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    if name == "op3_lm_score":
        train = [t for i, t, *_ in docs if (zlib.crc32(str(i).encode()) % 5 if i is not None else 0) != 1]
        counts = Counter(w for t in train for w in [*(t or "").lower().split(), None])
        n, v = sum(counts.values()), len(counts)
        want = sorted(round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*(t or "").lower().split(), None]), 6) for _, t, *_ in docs)
        assert sorted(round(r.base_score, 6) for r in rows) == want and {r.train_tokens for r in rows} == {n}
    if name == "op4_pii":
        got = next(r for r in rows if r.doc_id == 152)
        assert (got.n_email, got.n_ip, got.spans) == (1, 1, "email:5:22,ip:27:35") and got.base_sha256 == hashlib.sha256(got.spans.encode()).hexdigest()
    if name == "op5_secrets":
        assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    if name == "op8_jaccard_join":
        assert {r.component_id for r in rows if r.doc_id in (7, 153)} == {7} and {r.component_id for r in rows if r.doc_id == 5} == {5}
    if name == "op9_language":
        assert all((r.lang_pred == "und") == (r.doc_id in (150, 151)) and 0 <= r.score <= 1 for r in rows)
    if name == "op11_mixing":
        assert all(r.taken <= 2 * r["size"] for r in rows) and {r.doc_id: r["size"] for r in rows}[154] == 200_000
        by = Counter()
        for r in rows:
            by[r.source_size, r.target] += r.taken
        assert all(abs(n - target) <= 0.5 for (_, target), n in by.items())
    if name == "op10_fingerprint":
        order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want = Counter()
        for k, (_, t, *_) in enumerate(order):
            t, after = t or "", order[(k + 1) % len(order)][1] or ""
            want[hashlib.sha256((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode()).hexdigest()] += 1
        assert Counter(r.edited_sha256 for r in rows) == want
        assert len({r.fingerprint for r in rows if r.doc_id == 5}) == 1


def test_pipeline_of_empty_tables_and_odd_rows(spark, made):
    import corpus_pipeline

    folder, empty, docs, _ = made
    assert corpus_pipeline.run(spark, empty).count() == 0
    near = corpus_pipeline.keep_one_of_near_copies(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    got = Counter(r.doc_id for r in near.collect())
    want = Counter(r[0] for r in docs)
    want[5], want[153] = 1, 0  # equal rows, and a copy
    assert got == +want  # both texts of id 3 stay, and the row without an id
