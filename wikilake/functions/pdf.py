"""Text of PDF files as columns: cleaning in seven passes, titles and metadata.

A text's lines are an array and its blocks another; every pass is an expression on them, so whole texts stay in their rows and nothing
leaves the JVM.  Nulls stay null, an empty text is empty; texts of any length take time in proportion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wikilake.functions.text import bound, lines

# Lines that are boilerplate, lines that open a paper's text, captions, and words that only prose has.
PDF_DROPPED = (
    r"arXiv:\s*\d+\.\d+v?\d*\s*\[.*",
    r"Preprint\.\s*Under\s+review\.?\s*",
    r"Under\s+review\s+as\s+a\s+conference\s+paper.*",
    r"Published\s+as\s+a\s+conference\s+paper.*",
    r"Copyright\s+©?\s*\d{4}.*",
    r"\d{1,3}\s*",
    r"\d+(\.\d+)?\s*",
    r"Page\s+\d+\s+of\s+\d+",
    r"\*+\s*",
    r"†+\s*",
    r"These\s+authors\s+contributed\s+equally.*",
)
PDF_OPENERS = (r"Abstract", r"ABSTRACT", r"(?:1\.?\s+)?Introduction", r"(?i:I\.\s+INTRODUCTION)", r"(?i:Executive\s+Summary)")
PDF_CAPTION = r"(?:Figure|Table|Algorithm|Listing)\s+\d+[:.]|\d+(?:\.\d+)?\s+[A-Z]|[IVX]+\.\s+[A-Z]"
PDF_WORDS = tuple("the a an of and to in is for with that this are on as be or not by from at we our their its it but if than have has can was were these those".split())
PDF_LONG, PDF_COVER, PDF_TITLE = 60, 40, (8, 200)


def _whole(*rules: str) -> str:
    """A pattern for lines that one of the rules fits from end to end."""
    return "(?U)^(?:" + "|".join(rules) + ")$"


def tidied(text: Column) -> Column:
    """The trimmed lines, with capitals that tracking has set apart joined, twice for chains."""
    apart = r"(?U)\b([A-Z]) ([A-Z]{2,})\b"
    return F.transform(lines(text), lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), apart, "$1$2"), apart, "$1$2"))


def prose(line: Column) -> Column:
    """A line that ends like a sentence, is a caption or heading, or is long and has two common words."""
    words = F.filter(F.regexp_extract_all(F.lower(line), F.lit(r"(?U)\b[a-z]+\b"), F.lit(0)), lambda w: w.isin(*PDF_WORDS))
    return line.rlike(r"(?U)[.!?:;]\s*$") | line.rlike(f"(?U)^(?:{PDF_CAPTION})") | ((F.length(line) > PDF_LONG) & (F.size(words) >= 2))


def _blocks(text: Column) -> Column:
    """(blank, rows, loose) of the blocks of a text without white space at the ends of lines: blank lines before each, its lines, and
    whether none of them is prose."""
    found = F.regexp_extract_all(text, F.lit(r"\n*[^\n]+(?:\n[^\n]+)*"), F.lit(0))

    def block(x: Column, i: Column) -> Column:
        gap = F.length(F.regexp_extract(x, r"^(\n*)", 1))
        rows = F.split(F.regexp_replace(x, r"^\n+", ""), "\n")
        return F.struct((gap - F.when(i > 0, 1).otherwise(0)).alias("blank"), rows.alias("rows"), (~F.exists(rows, prose)).alias("loose"))

    return F.transform(found, block)


def _without_charts(blocks: Column) -> Column:
    """The lines of all blocks but of loose ones that follow each other, as the labels of charts do.  Of such a run the blank lines before
    it stay."""
    loose = lambda i: F.coalesce(F.get(blocks, i).loose, F.lit(False))
    blank = lambda b: F.array_repeat(F.lit(""), b.blank.cast("int"))
    none = F.array().cast("array<string>")
    kept = lambda b, i: F.when(~b.loose | ~(loose(i - 1) | loose(i + 1)), F.concat(blank(b), b.rows)).when(loose(i - 1), none).otherwise(blank(b))
    return F.flatten(F.transform(blocks, kept))


def pdf_text(text: Column) -> Column:
    """A PDF's text: lines trimmed, spaced capitals closed, boilerplate dropped, hyphenated line ends joined (the hyphen
    stays), clusters of short blocks dropped, the cover skipped, blank runs cut."""
    rows = F.filter(tidied(text), lambda x: ~x.rlike("(?i)" + _whole(*PDF_DROPPED)))
    joined = F.regexp_replace(F.array_join(rows, "\n"), r"([a-z]-)\n(?=[a-z])([^\n]*)", "$1$2")

    def rest(t: Column) -> Column:
        tail = F.array_repeat(F.lit(""), F.length(F.regexp_extract(t, r"(\n*)\z", 1)))
        return bound(F.concat(bound(_blocks(t), _without_charts), tail), uncovered)

    def uncovered(kept: Column) -> Column:
        opener = F.array_position(F.transform(F.slice(kept, 1, PDF_COVER), lambda x: x.rlike(_whole(*PDF_OPENERS))), True).cast("int")
        return F.array_join(F.slice(kept, F.greatest(opener, F.lit(1)), F.size(kept)), "\n")

    short = F.regexp_replace(bound(joined, rest), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(short, r"\A\n+", ""), r"\n+\z", "\n")


def title_of_pdf(page: Column) -> Column:
    """A title from the first page's text: its first line that may be one, with the next if it ends in a colon."""
    least, most = PDF_TITLE
    fits = lambda x: (F.length(x).between(least, most)) & ~x.rlike("(?i)^arXiv:") & ~x.rlike(r"(?U)^(?:\d{4}-\d{2}-\d{2}|\d{1,2}\s+\w+\s+\d{4})$")
    both = lambda rows: F.trim(F.regexp_replace(F.concat(rows[0], F.lit(" "), rows[1]), r"(?U)\s+", " "))
    return bound(F.filter(tidied(page), fits), lambda rows: F.when((F.size(rows) > 1) & rows[0].endswith(":"), both(rows)).otherwise(F.get(rows, F.lit(0))))


def choose_title(title: Column, subject: Column, fallback: Column) -> Column:
    """A PDF's title, else its subject, else the fallback marked as a PDF's."""
    return F.when(title != "", title).when(subject != "", subject).otherwise(F.concat(F.lit("PDF: "), fallback))


def pdf_date(raw: Column) -> Column:
    """D:20240819163025+02'00' as 2024-08-19 16:30; anything else as it is."""
    m = r"D:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})"
    return F.when(raw.rlike(m), F.regexp_replace(raw, f"(?s)^.*?{m}.*$", "$1-$2-$3 $4:$5")).otherwise(raw)
