"""The trie against one built in Python, also with stretches of a few places, and against its SQL."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wikilake.llm import prefixes


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "x", 2, 3) for r in rows], "conv_id long, turn long, role string, text string, place int, node string, digest string, words int, base int")


def rebuilt(rows):
    own = defaultdict(list)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, md5(role or "") + md5(text or ""), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + v[h:]
    return out


def brute(rows):
    members = defaultdict(list)
    convs = rebuilt(rows)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, spared = Counter(), Counter()
    for k, m in members.items():
        n = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            spared[k[:d]] += n
    digest = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if len(convs[c]) == len(k)).encode()).hexdigest()
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], spared[k], digest(k)) for k, m in members.items())


def sample(rng):
    rows = []
    text = lambda: " ".join(rng.choice(["yes", "no", "well\n", "ünder", "x\x0by"], int(rng.integers(0, 4))))
    for c in range(130):
        if c not in (40, 41, 60):  # bases that are absent
            rows += [(c, t, ["user", "assistant"][t % 2], text()) for t in range(int(rng.integers(1, 7)))]
    rows += [(c, t, "user", f"same {t}") for c in range(400, 440) for t in range(4)]  # a large group of copies
    rows += [(200, t, "user", "long") for t in range(60)] + [(201, t, "user", "long") for t in range(45)] + [(221, 0, None, None)]
    rows += [(7, None, "user", "first of all"), (7, None, "user", "first of all"), (7, 2, "tool", "tie"), (7, 2, None, "tie"), (None, 0, "user", "nobody's"), (None, None, None, None)]
    rows += [(-3, 0, "user", "below"), (-3, 1, "user", "zero"), (-20, 0, "user", "below"), (10**15, 0, "user", "far"), rows[5], rows[5]]
    return rows


@pytest.mark.parametrize(("stretch", "run"), [(4_096, 1_024), (3, 2)])
def test_trie_equals_brute_force(spark, monkeypatch, stretch, run):
    rows = sample(np.random.default_rng(4))
    monkeypatch.setattr(prefixes, "STRETCH", stretch)
    monkeypatch.setattr(prefixes, "RUN", run)
    got = prefixes.trie(frame(spark, rows).repartition(5))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_light_steps_are_few(spark):
    """A comb: conversation k leaves the common path after k turns; all lie one light step away."""
    rows = [(20 * k, t, "user", "on" if t < k else "off") for k in range(1, 30) for t in range(k + 1)]
    assert Counter(map(tuple, prefixes.trie(frame(spark, rows)).collect())) == brute(rows)


def test_odd_tables(spark):
    assert prefixes.trie(frame(spark, [])).collect() == []
    assert prefixes.trie(frame(spark, [(None, 1, "user", "x")])).collect() == []
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1)
    [one] = prefixes.trie(frame(spark, [(turnless, 0, "user", "x")])).collect()
    assert tuple(one) == (turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())
    long = "word " * 300_000
    rows = [(20, 0, "user", long), (40, 0, "user", long), (60, 0, "user", long + "!")]
    assert Counter(map(tuple, prefixes.trie(frame(spark, rows)).collect())) == brute(rows)


def test_query_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    frame(spark, sample(np.random.default_rng(8))).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert Counter(map(tuple, prefixes.op12_prefix_trie(spark, str(tmp_path)).collect())) == Counter(con.sql(prefixes.SQL).fetchall())
