"""Fences line by line in Python against the columns, their time on long texts, and the parts of a batch response."""

import random
import re
import time

from pyspark.sql import functions as F

from wikilake.functions import markdown as M
from wikilake.functions import text as T
from wikilake.operators import curation


def marked(text):
    out, open_ = [], False
    for line in re.split(r"\r?\n", text):
        fence = line.startswith("```")
        out.append((line, open_ or fence))
        open_ ^= fence
    return out


def test_fences_equal_a_loop_over_lines(spark):
    rng = random.Random(3)
    texts = ["", "\n", "```", "```\n", "```\n```", "a\n```\n```\n\nb", "```x\ry\n```\nz", "a\r\n```\r\nb\r\n```\r\nc\r\n", "x ```\ny", "[[a]]\n```\n[[b]]", None]
    texts += ["".join(rng.choice(["```", "a", " ```", "[[b|c]]", "\n", "\n", "\r\n", "****", "\n```\n"]) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    t = F.col("t")
    rows = df.select("k", T.outside_fences(t).alias("out"), T.fenced_lines(t).alias("lines"), T.outside(t, lambda x: F.concat(F.lit("<"), x, F.lit(">"))).alias("wrapped"), T.collapse_asterisks(t).alias("stars")).collect()
    for r in rows:
        if texts[r.k] is None:
            assert r.lines is None and r.stars is None
            continue
        want = marked(texts[r.k])
        assert [(x.line, x.fenced) for x in r.lines] == want, texts[r.k]
        assert r.out == [x for x, f in want if not f], texts[r.k]
        assert re.sub("[<>]", "", r.wrapped) == texts[r.k]
        keep = re.sub(r"\r?\n", "\n", texts[r.k])
        assert re.sub(r"\r?\n", "\n", r.stars) == "\n".join(x if f else re.sub(r"\*{4,}", "**", x) for x, f in marked(keep))


def test_long_texts_take_linear_time(spark):
    long = "\n".join(f"line {k} [[a {k % 9}]]" if k % 10 else "```" for k in range(100_000))
    df = spark.createDataFrame([(long,)], "t string")
    functions = (lambda t: F.size(T.outside_fences(t)), lambda t: F.size(T.link_places(t)), lambda t: F.length(T.collapse_asterisks(t)))
    for f in functions:
        df.limit(0).select(f(F.col("t"))).collect()
        began = time.time()
        assert df.select(f(F.col("t")).alias("n")).first().n > 0
        assert time.time() - began < 10  # a second or two alone


def test_open_fences_are_left_alone_by_cleanups():
    body = "[Ann](/u/ann)\n```\n[Bob](/u/bob)\n"
    text, applied = M.cleaned(body)
    assert "Ann" not in text and "[Bob](/u/bob)" in text and applied == ["strip-avatars"]
    assert M.cleaned("```\n[Bob](/u/bob)")[1] == [] and "Cid" not in M.cleaned("```\n[Bob](/u/bob)\n```\n[Cid](/u/cid)")[0]


def test_batch_parts(spark):
    raw = "Sure!\n=== entity: A B ===\nthe loss a = b + c falls\n=== x ===\n=== entity: C ===  \n\n=== entity: D ===\nold\n=== entity: D ===\nnew\n\n```\nand bye\n=== entity: E ===\nlast one\n```"
    rows = spark.createDataFrame([(raw,), ("",), (None,), ("no part",)], "t string").select(curation.batch_parts(F.col("t")).alias("b")).collect()
    assert [tuple(x) for x in rows[0].b] == [("A B", "the loss a = b + c falls\n=== x ==="), ("D", "new"), ("E", "last one")]
    assert rows[1].b == [] and rows[2].b is None and rows[3].b == []


def test_links_by_their_brackets():
    assert [(x.begin, x.target, x.image) for x in M.scan_links('a [b [c](d "t")](e) ![f](g) [h] (i) [j](k l) ](x)')] == [(2, "e", False), (5, "d", False), (21, "g", True)]
    wrapped = {
        "[\n\n![i](j)\n\n](h)": "[![i](j)](h)",
        "[\n a\nb \n](h)": "[a b](h)",
        "[one line\n\n](h)": "[one line](h)",
        "[ \n\n ](h)": "",
        "[one\n](h)": "[one\n](h)",
        "[a\n\nb](h)": "[a\n\nb](h)",
        f"[\n{'x' * 301}\n](h)": f"[\n{'x' * 301}\n](h)",
        "![\na\n](h)": "![\na\n](h)",
        "x [\nsee [y](z)\n](h) w": "x [see [y](z)](h) w",
    }
    assert {k: M.collapse_links(k) for k in wrapped} == wrapped
    gone = "[![a](b)](/users/ann)", "[Ann](/ann.b)", "[Ann](/U/ann/)", "[![a](b)](/@ann)"
    kept = "[Ann](/a/b/c)", "[Ann](/blog/ann)", "[Ann](http://h/u/ann)", f"[{'x' * 61}](/ann)", "![a](/ann.png)", "[a [b] c](/ann)"
    assert [M.strip_avatars(f"x{k}y") for k in gone] == ["xy"] * 4 and [M.strip_avatars(k) for k in kept] == list(kept)
    assert M.strip_avatars("a\n\n [Ann](/ann) \n\nb") == "a\n\nb"
    row = "".join(f"[link number {k}](http://h.org/a/long/path/{k})" for k in range(6))
    assert M.split_link_rows(row) == row.replace(")[", ") · [") and M.split_link_rows(row[:90]) == row[:90]
    assert M.split_link_rows(row + "[1](x)") == row.replace(")[", ") · [") + "[1](x)"


def test_texts_are_read_by_strings_as_by_lines(spark):
    """Counts, sections and what stands outside fences, with breaks of two characters, open fences and edges, against plain loops."""
    from pyspark.sql import functions as F

    from wikilake.functions import text as T
    from wikilake.operators import curation

    pieces = ["# a", "## b", "##", "#\t", "| - |", "x ** y", "** z **", "```", "```py", " Share ", "x 附录（位置未识别）", "", " ## Observations ", "## Observations", "- one", "## End"]
    import random

    rng = random.Random(5)
    given = ["", "\n", "```", "```\n", "```\n```", "## Observations", "## Observations\n## End", "a\r\n## Observations\r\n\r\n## End"]
    given += [rng.choice(["\n", "\r\n"]).join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(150)]

    def plain(text):
        rows = text.replace("\r\n", "\n").split("\n")
        out, open_ = [], False
        for x in rows:
            if x.startswith("```"):
                open_ = not open_
            elif not open_:
                out.append(x)
        begin = next((k for k, x in enumerate(rows) if x.strip(" ") == "## Observations"), None)
        own = None
        if begin is not None:
            stop = next((k for k in range(begin + 1, len(rows)) if rows[k].startswith(("# ", "## "))), len(rows))
            own = "\n".join(rows[begin + 1 : stop])
        at = next((k for k, x in enumerate(rows) if x.rstrip(" ") == "## Observations"), None)
        if at is None:
            new = text.rstrip() + "\n\n## Observations\nnew"
        else:
            stop = next((k for k in range(at + 1, len(rows)) if rows[k].startswith(("# ", "## "))), len(rows))
            new = "\n".join([*rows[: at + 1], "new", *rows[stop:]])
        counts = (sum(x.startswith("# ") for x in out), sum(x.startswith("## ") for x in out), sum(x.count("**") % 2 for x in out), sum(x.strip("#") != x and not x.strip("# \t") for x in out), sum(x == "| - |" for x in out), sum(x.strip(" ") == "Share" for x in out), sum("附录" in x for x in out), sum(x.startswith("```") for x in rows))
        return out, own, own and own.strip() if own is not None else None, new, counts

    df = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, t string")
    f = T.feature_row(F.col("t"))
    rows = df.select("k", T.strip_fences(F.col("t")).alias("out"), T.section(F.col("t"), "Observations", trimmed=False).alias("own"), T.section(F.col("t"), "Observations").alias("bare"), curation.with_section(F.col("t"), "Observations", F.lit("new")).alias("new"), f.alias("f")).orderBy("k").collect()
    for t, r in zip(given, rows, strict=True):
        out, own, bare, new, counts = plain(t)
        assert (r.out, r.own, r.bare, r.new) == ("\n".join(out), own, bare, new), t
        assert (r.f.h1, r.f.h2, r.f.unbalanced_bold, r.f.empty_headings, r.f.tables, r.f.chrome, r.f.appendix_marks, r.f.fences) == counts, t


def test_long_texts_go_to_python_in_small_batches(spark, tmp_path):
    from wikilake.plans import adapters as A

    spark.range(1).write.parquet(str(tmp_path / "pages.parquet"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    A.table(spark, str(tmp_path), "pages")
    assert int(spark.conf.get(key)) <= 1000
    spark.conf.set(key, before)
