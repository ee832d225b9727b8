"""PDF text in columns against a loop over lines, on whole texts and on made ones."""

import random
import re
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F

from wikilake.functions import pdf

WORDS = set(pdf.PDF_WORDS)


def tidied(text):
    rows = [x.strip() for x in re.split(r"\r?\n", text)]
    for _ in range(2):
        rows = [re.sub(r"\b([A-Z]) ([A-Z]{2,})\b", r"\1\2", x) for x in rows]
    return rows


def prose(line):
    return bool(re.search(r"[.!?:;]\s*$", line) or re.match(pdf.PDF_CAPTION, line) or (len(line) > 60 and sum(w in WORDS for w in re.findall(r"\b[a-z]+\b", line.lower())) >= 2))


def brute(text):
    rows = "\n".join(x for x in tidied(text) if not re.fullmatch("(?i:" + "|".join(pdf.PDF_DROPPED) + ")", x))
    rows = re.sub(r"([a-z]-)\n(?=[a-z])([^\n]*)", r"\1\2", rows).split("\n")
    blocks = [(blank, list(g)) for blank, g in groupby(rows, key=lambda x: x == "")]
    loose = [not blank and not any(map(prose, g)) for blank, g in blocks]
    kept, k = [], 0
    while k < len(blocks):
        end = k
        while loose[k] and end + 2 < len(blocks) and loose[end + 2]:
            end += 2
        if end == k:
            kept += blocks[k][1]
        k = end + 1
    cover = next((n for n, x in enumerate(kept[:40]) if re.fullmatch("|".join(pdf.PDF_OPENERS), x)), 0)
    return re.sub(r"\n+\s*\Z", "\n", re.sub(r"\A\s*\n+", "", re.sub(r"\n{3,}", "\n\n", "\n".join(kept[cover:]))))


def test_texts_of_pdfs(spark):
    rng = random.Random(4)
    parts = ["Speed", "Model A", "F LUX X AB", "a long enough line of the words that is prose in itself for sure yes", "Ends.", "wor-", "ld goes on", "12", "Abstract", "1. Introduction", "Figure 3: x", " \t ", "", "", "", "arXiv:2401.1 [cs] x", "Page 1 of 2", "é È", "***", "Introduction"]
    made = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(400)] + ["", "\n\n", "x", "Speed\n\nModel", "a\r\nb\r\n"]
    whole = [t for t in pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text if t is not None]
    texts = made + whole
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "k int, t string").repartition(4)
    rows = df.select("k", pdf.pdf_text(F.col("t")).alias("x")).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r.x == (None if r.k < 0 else brute(texts[r.k])), texts[r.k]


def test_metadata(spark):
    df = spark.createDataFrame([("t", "s", "f", "D:20240819163025+02'00'"), ("", "s", "f", "x"), (None, "", "f", None)], "t string, s string, f string, d string")
    assert [tuple(r) for r in df.select(pdf.choose_title(F.col("t"), F.col("s"), F.col("f")), pdf.pdf_date(F.col("d"))).collect()] == [("t", "2024-08-19 16:30"), ("s", "x"), ("PDF: f", None)]
