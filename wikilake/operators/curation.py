"""Rewrites of pages as pure table-to-table operations, the curation queue, and prompt measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikilake.functions import text as T

CONFIDENCE = ("low", "medium", "high")
INPUT_PRICE, OUTPUT_PRICE, OUTPUT_SHARE = 3.0, 15.0, 0.3  # dollars a million tokens


def renamed(docs: DataFrame, old: str, new: str) -> DataFrame:
    """docs (slug, body) with a page's slug and heading changed and all links to it rewritten; changed tells which rows differ."""
    taken = docs.where(F.col("slug") == new).limit(1).count()
    if taken:
        raise ValueError(f"{new} exists")
    title = F.regexp_replace("body", r"\A(\s*)# [^\n]*", f"$1# {new}")
    body = T.rewrite_links(F.when(F.col("slug") == old, title).otherwise(F.col("body")), old, new)
    return docs.withColumn("changed", (F.col("slug") == old) | (body != F.col("body"))).withColumn("body", body).withColumn("slug", F.when(F.col("slug") == old, new).otherwise(F.col("slug")))


def merged(docs: DataFrame, source: str, target: str, forced: bool = False) -> DataFrame:
    """docs without the source page; the target gets its observations and a mark that it is stale, links are rewritten.  If docs has a tier,
    an active page isn't merged into one that was only seen, unless forced; the target keeps its tier."""
    if "tier" in docs.columns and not forced:
        tiers = {r.slug: r.tier for r in docs.where(F.col("slug").isin(source, target)).select("slug", "tier").limit(2).collect()}
        if (tiers.get(source), tiers.get(target)) == ("active", "seen"):
            raise ValueError(f"{source} is active, {target} only seen")
    given = docs.where(F.col("slug") == source).select(F.array_join(T.observations(F.col("body")), "\n").alias("given"))
    joined = docs.where(F.col("slug") != source).join(F.broadcast(given.limit(1)), F.lit(True), "left")  # one row
    more = F.when((F.col("slug") == target) & (F.coalesce("given", F.lit("")) != ""), F.concat(F.lit(f"\n<!-- merged from {source} -->\n"), "given", F.lit("\n<!-- synthesis: stale -->\n"))).otherwise("")
    return joined.withColumn("body", F.concat(T.rewrite_links(F.col("body"), source, target), more)).drop("given")


def deletable(docs: DataFrame, cites: DataFrame, forced: bool = False) -> DataFrame:
    """Pages (slug) that no other page cites; all if forced."""
    cited = cites.where("src <> dst").select(F.col("dst").alias("slug"))
    return docs if forced else docs.join(cited, "slug", "left_anti")


def orphans_to_delete(items: DataFrame) -> DataFrame:
    return items.where("tier = 'seen' and refs = 0")


def with_heading(body: Column, heading: str) -> Column:
    """The heading at the end unless it is there."""
    return F.when(T.section(body, heading).isNotNull(), body).otherwise(F.concat(F.regexp_replace(body, r"\s+\z", ""), F.lit(f"\n\n## {heading}\n")))


def with_section(body: Column, heading: str, text: Column) -> Column:
    """The section's body replaced; the section is added if it isn't there."""
    whole, line = F.replace(body, F.lit("\r\n"), F.lit("\n")), rf"(?md)^## {T.quoted(heading)} *$"
    cut = F.split(whole, line, 2)
    behind = F.get(cut, F.lit(1))  # null without the heading
    tail = F.coalesce(F.concat(F.lit("\n"), F.get(F.split(behind, "(?md)(?=^##? )", 2), F.lit(1))), F.lit(""))
    new = F.concat(F.get(cut, F.lit(0)), F.regexp_extract(whole, line, 0), F.lit("\n"), text, tail)
    return F.when(behind.isNotNull(), new).otherwise(F.concat(F.regexp_replace(body, r"\s+\z", ""), F.lit(f"\n\n## {heading}\n"), text))


def dated(raw: Column, day: str) -> Column:
    """A page whose frontmatter says that it was updated and synthesised on a day; synthesis_updated_at is put behind updated,
    or at the end, if it isn't there.  Without frontmatter nothing changes."""
    return F.concat(_stamped(T.frontmatter(raw), day), T.body(raw))


def _stamped(head: Column, day: str) -> Column:
    stamp = f"synthesis_updated_at: {day}"

    def stamped(head: Column) -> Column:
        there, updated = r"(?m)^synthesis_updated_at:[^\S\n]*\S[^\n]*$", r"(?m)^(updated:[^\S\n]*\S[^\n]*)$"
        new = F.when(head.rlike(there), F.regexp_replace(head, there, stamp)).when(head.rlike(updated), F.regexp_replace(head, updated, f"$1\n{stamp}")).otherwise(F.regexp_replace(head, r"\n---\r?\n\z", f"\n{stamp}\n---\n"))
        return F.regexp_replace(new, updated, f"updated: {day}")

    return T.bound(head, lambda head: F.when(head == "", head).otherwise(stamped(head)))


def refined(raw: Column, heading: str, text: Column, day: str) -> Column:
    """A page with a new section and the day on which it was made; runs of blank lines become one."""
    fresh = F.concat(F.lit("\n"), F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n"))
    new = F.regexp_replace(with_section(T.body(raw), heading, fresh), r"\n{3,}", "\n\n")
    head = T.frontmatter(raw)
    return F.when(head == "", dated(new, day)).otherwise(F.concat(_stamped(head, day), new))


def backfilled_date(synthesised: Column, body: Column, updated: Column) -> Column:
    return F.coalesce(synthesised, F.when(~T.is_stub(T.section(body, "Synthesis")), updated))


def scaffold(kind: str, name: Column, created: Column) -> Column:
    """A new entity's or topic's page."""
    extra = "refs: 0\ntier: seen" if kind == "entity" else "source_count: 0"
    parts = "## Synthesis\n\n## Observations\n" if kind == "entity" else "## What\n\n## Current understanding\n\n## Open threads\n\n## Sources drawn on\n"
    return F.concat(F.lit(f"---\ntype: {kind}\ncreated: "), created, F.lit("\nupdated: "), created, F.lit(f"\n{extra}\n---\n# "), name, F.lit(f"\n\n{parts}"))


def valid_name(name: Column) -> Column:
    return name.rlike(r"^[^/\\:*?\"<>|\[\]#^]{1,80}$") & (F.trim(name) == name)


def prepended(log: Column, entry: Column) -> Column:
    """A log with a new entry after its marker, else after the first heading, else in front."""
    marker = "<!-- entries -->\n"
    return F.when(F.contains(log, F.lit(marker)), F.replace(log, F.lit(marker), F.concat(F.lit(marker), entry, F.lit("\n")))).when(log.rlike(r"(?m)^# "), F.regexp_replace(log, r"(?s)\A(.*?^# [^\n]*\n)|\A", "$1")).otherwise(F.concat(entry, F.lit("\n"), log))


def alias_merges(aliases: DataFrame, items: DataFrame) -> DataFrame:
    """Aliases (variant, canonical) of which both pages (slug) exist."""
    there = lambda c: items.select(F.col("slug").alias(c))
    return aliases.join(there("variant"), "variant", "left_semi").join(there("canonical"), "canonical", "left_semi").select("variant", "canonical")


def normalized_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    return names.join(aliases.select(F.col("variant").alias("name"), "canonical"), "name", "left").withColumn("name", F.coalesce("canonical", "name")).drop("canonical")


def detected_entities(detected: DataFrame, aliases: DataFrame, items: DataFrame, body: DataFrame | None = None) -> DataFrame:
    """(name, state): active, seen or new, after aliases."""
    return normalized_names(detected, aliases).join(items.select(F.col("slug").alias("name"), "tier"), "name", "left").withColumn("state", F.coalesce("tier", F.lit("new"))).drop("tier")


def should_dispatch(ticked: Column, confidence: Column, level: str) -> Column:
    """Ticked by hand, or confident enough."""
    order = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.lower(confidence))
    return ticked | (order >= CONFIDENCE.index(level) + 1)


def proposals(findings: DataFrame) -> DataFrame:
    """Findings (path, kind, command) numbered; those without a command are skipped."""
    n = F.row_number().over(Window.partitionBy("kind").orderBy("path"))
    act = F.col("command").isNotNull()
    return findings.withColumn("n", n).withColumn("state", F.when(act, "actionable").otherwise("skipped")).withColumn("line", F.when(act, F.format_string("- [ ] %s-%d: `%s`", F.col("kind"), F.col("n"), F.col("command"))))


def stale_order(stale: DataFrame, limit: int) -> DataFrame:
    """Stale items (slug, lag), the furthest behind first; what is over the limit is deferred, not dropped."""
    top = stale.orderBy(F.desc("lag"), "slug").limit(limit).select("slug", F.lit(False).alias("deferred"))
    return stale.join(top, "slug", "left").withColumn("deferred", F.coalesce("deferred", F.lit(True)))


def tokens(chars: Column) -> Column:
    return F.round(chars / 4).cast("long")


def cost(n_tokens: Column) -> Column:
    """Dollars for the input and an output of 0.3 of its size."""
    return F.round(n_tokens * F.lit(INPUT_PRICE / 1e6) + n_tokens * F.lit(OUTPUT_SHARE * OUTPUT_PRICE / 1e6), 7)


def measures(prompts: DataFrame) -> DataFrame:
    """Count, characters and tokens of prompts (kind, chars) by kind."""
    return prompts.groupBy("kind").agg(F.count("*").alias("prompts"), F.sum("chars").alias("chars"), F.sum(tokens(F.col("chars"))).alias("tokens"))


#: Fixed value: the line that begins an entity's part of a batch response.
MARKER = r"=== entity: (.+?) ===\s*"


def batch_parts(response: Column) -> Column:
    """(name, text) of a response whose parts begin with a marker line `=== entity: name ===`, each but what a line of three backticks cuts
    off; empty parts are left out, and of parts of one name the last stands."""
    trimmed = lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")
    parts = F.filter(F.split(trimmed(response), rf"(?m)(?=^{MARKER}$)", -1), lambda p: p.rlike(rf"\A{MARKER}(\n|\z)"))
    named = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, rf"\A{MARKER}", 1)).alias("name"), trimmed(F.regexp_replace(trimmed(F.regexp_replace(p, r"\A[^\n]*\n?", "")), r"(?s)\n```.*", "")).alias("text")))
    full = F.filter(named, lambda x: (x["name"] != "") & (x.text != ""))
    return T.bound(full, lambda rows: F.filter(rows, lambda x, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda y: y["name"] == x["name"])))


def unmatched(asked: DataFrame, given: DataFrame) -> DataFrame:
    """(name, side) of names (name) only asked for or only given."""
    rows = asked.withColumn("a", F.lit(1)).join(given.withColumn("g", F.lit(1)), "name", "full").where("a is null or g is null")
    return rows.select("name", F.when(F.col("g").isNull(), "missing").otherwise("unmatched").alias("side"))


TOPIC_SECTIONS, UNDERSTANDING = ("What", "Current understanding", "Open threads", "Sources drawn on"), "Current understanding"


def merged_topics(docs: DataFrame, source: str, target: str, day: str) -> DataFrame:
    """docs (slug, body) without the source topic; the target's sections get what the source's have to say, under a mark, and its
    understanding is marked stale unless both were stubs.  Links are rewritten."""
    given = docs.where(F.col("slug") == source).select(F.col("body").alias("_given")).limit(1)
    joined = docs.where(F.col("slug") != source).join(F.broadcast(given), F.lit(True), "left")  # one row

    def grown(name: str, x: Column) -> Column:
        block = F.concat(F.lit(f"<!-- merged from `{source}` on {day} -->\n\n"), x.more, F.lit("\n"))
        lead = F.lit("")
        if name == UNDERSTANDING:
            lead = F.when(~T.is_stub(x.own) | ~T.is_stub(x.more), f"<!-- TODO: re-synthesize ## {name} (post-merge {day}) -->\n\n").otherwise("")
        text = F.concat(F.lit("\n"), lead, F.when(x.own == "", "").otherwise(F.concat(x.own, F.lit("\n\n"))), block)
        added = F.concat(F.regexp_replace(x.body, r"\s+\z", ""), F.lit(f"\n\n## {name}\n\n"), block)
        return F.when(F.coalesce(x.more, F.lit("")) == "", x.body).when(x.own.isNull(), added).otherwise(with_section(x.body, name, text))

    body = F.col("body")
    for name in TOPIC_SECTIONS:  # each step reads the body that the one before has made
        body = T.bound(body, lambda b, name=name: T.bound(F.struct(b.alias("body"), T.section(b, name).alias("own"), T.section(F.col("_given"), name).alias("more")), lambda x: grown(name, x)))
    body = F.when((F.col("slug") == target) & F.col("_given").isNotNull(), body).otherwise(F.col("body"))
    return joined.withColumn("body", T.rewrite_links(body, source, target)).drop("_given")


ITEM = r"^### (\d+)\.\s+(.+?)\s+\[confidence:\s*(high|medium|low)\]\s*$"


def queue_items(queue: Column) -> Column:
    """Array of (n, heading, confidence, approved, rationale, command) of a queue's text: a section for each item, ticked or not, whose first
    fence has the command, comments apart."""
    parts = F.filter(F.split(queue, r"(?m)(?=^#{2,3}\s)", -1), lambda p: F.split(p, "\n")[0].rlike(ITEM))

    def item(p: Column) -> Column:
        head = F.split(p, "\n")[0]
        fence = F.regexp_extract(p, r"(?s)```\s*\n(.+?)```", 1)
        command = F.array_join(F.filter(F.split(fence, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#")), "\n")
        return F.struct(
            F.regexp_extract(head, ITEM, 1).cast("int").alias("n"),
            F.trim(F.regexp_extract(head, ITEM, 2)).alias("heading"),
            F.regexp_extract(head, ITEM, 3).alias("confidence"),
            p.rlike(r"(?im)^- \[x\]\s+approved").alias("approved"),
            F.trim(F.regexp_extract(p, r"(?m)^\*\*Rationale\*\*:\s*(.+)$", 1)).alias("rationale"),
            F.trim(command).alias("command"),
        )

    return F.transform(parts, item)


COUNTED, SELECTED, SHOWN = ("dead-wikilinks", "tier-mismatch", "tag-vocabulary"), ("dead-wikilinks", "tier-mismatch", "tag-vocabulary", "topic-content-gaps"), 30


def finding_count(issues: DataFrame, audits: DataFrame) -> DataFrame:
    """(findings): the findings of audits (one row each) and the issues (kind) of the kinds that count."""
    kept = issues.where(F.col("kind").isin(*COUNTED)).select(F.lit(1).alias("x")).unionByName(audits.select(F.lit(1).alias("x")))
    return kept.agg(F.count("*").alias("findings"))


def selected_findings(issues: DataFrame, most: int = SHOWN) -> DataFrame:
    """The first issues (kind, severity, path, detail) worth a proposal, as lines, and how many there are."""
    kept = issues.where(F.col("kind").isin(*SELECTED))
    line = F.concat(F.lit("- ["), "severity", F.lit("] "), "kind", F.lit(" — "), "path", F.lit(": "), "detail")
    return kept.select(line.alias("line")).orderBy("line").limit(most).join(F.broadcast(kept.agg(F.count("*").alias("total"))))  # one row


def cited_sources(docs: DataFrame, sources: DataFrame, text: Column) -> DataFrame:
    """(slug, cited, resolved) of pages (slug, body): what a text of theirs links to, and whether that is a source (slug)."""
    rows = docs.select("slug", F.explode(T.wikilinks(text)).alias("link"))
    token = F.regexp_replace(F.regexp_replace("link", r"^(?:03_)?Sources/(?:\d{4}/)?", ""), r"\.md$", "")
    known = sources.select(F.col("slug").alias("cited"), F.lit(True).alias("resolved"))
    return rows.select("slug", token.alias("cited")).distinct().join(known, "cited", "left").select("slug", "cited", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def entity_context(docs: DataFrame, sources: DataFrame, headings: tuple[str, ...]) -> DataFrame:
    """(slug, synthesis, observations, sources, unresolved) of entities (slug, body): what a prompt is made of; sources: excerpts (slug, body) of
    those cited, in the order of their slugs."""
    b = F.col("body")
    cites = cited_sources(docs.select("slug", F.array_join(T.observations(b), "\n").alias("body")), sources, F.col("body"))
    given = cites.where("resolved").join(sources.select(F.col("slug").alias("cited"), T.excerpt(b, headings).alias("text")), "cited")
    blocks = given.groupBy("slug").agg(F.array_sort(F.collect_list(F.concat(F.lit("### Source: "), "cited", F.lit("\n\n"), "text"))).alias("sources"))
    lost = cites.where("not resolved").groupBy("slug").agg(F.array_sort(F.collect_list("cited")).alias("unresolved"))
    none = F.array().cast("array<string>")
    bullets = F.transform(T.observations(b), lambda x: F.trim(F.regexp_replace(x, r"^-\s+", "")))
    rows = docs.select("slug", F.coalesce(T.section(b, "Synthesis"), F.lit("")).alias("synthesis"), bullets.alias("observations"))
    rows = rows.join(blocks, "slug", "left").join(lost, "slug", "left")
    return rows.select("slug", "synthesis", "observations", F.array_join(F.coalesce("sources", none), "\n\n").alias("sources"), F.coalesce("unresolved", none).alias("unresolved"))


def topic_citations(body: Column) -> Column:
    """Array of the sources that a topic links to: slugs that begin with a date, or paths of sources."""
    slug = lambda x: F.regexp_replace(F.regexp_replace(x, r"^(?:03_)?Sources/(?:\d{4}/)?", ""), r"\.md$", "")
    return F.array_distinct(F.transform(F.filter(T.wikilinks(body), lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2}-|^03_Sources/")), slug))


def topic_shape(body: Column) -> Column:
    return F.when(T.section(body, "Comparison").isNotNull(), "comparison").otherwise("survey")


#: What a source of a topic gives to its prompt.
EXCERPTED = ("TL;DR", "Key claims", "Visual observations", "What this changes", "Entities touched")


def topic_context(topics: DataFrame, sources: DataFrame, headings: tuple[str, ...] = EXCERPTED) -> DataFrame:
    """(slug, shape, what, understanding, comparison, sources, unresolved) of topics (slug, body): what a prompt is made of.  sources:
    excerpts of those of the table (slug, body) that are cited, in the order of their slugs; unresolved: citations that it lacks."""
    b = F.col("body")
    cites = topics.select("slug", F.explode(topic_citations(b)).alias("cited")).distinct()
    excerpts = sources.select(F.col("slug").alias("cited"), F.concat(F.lit("### Source: "), "slug", F.lit("\n\n"), T.excerpt(b, headings)).alias("block"))
    found = cites.join(excerpts, "cited", "left").groupBy("slug").agg(F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("cited", "block")))).alias("blocks"), F.array_sort(F.collect_list(F.when(F.col("block").isNull(), F.col("cited")))).alias("unresolved"))
    none = F.array().cast("array<string>")
    rows = topics.select("slug", topic_shape(b).alias("shape"), *(F.coalesce(T.section(b, name), F.lit("")).alias(alias) for name, alias in (("What", "what"), (UNDERSTANDING, "understanding"), ("Comparison", "comparison"))))
    return rows.join(found, "slug", "left").select("slug", "shape", "what", "understanding", "comparison", F.array_join(F.coalesce(F.transform("blocks", lambda x: x.block), none), "\n\n").alias("sources"), F.coalesce("unresolved", none).alias("unresolved"))


def top_context(topics: DataFrame) -> DataFrame:
    """(name, what, understanding, updated) of topics (slug, body, synthesised, updated) that are no stubs, for the root page."""
    b = F.col("body")
    understanding = T.section(b, UNDERSTANDING)
    rows = topics.where(~T.is_stub(understanding)).select(F.col("slug").alias("name"), F.coalesce(T.section(b, "What"), F.lit("")).alias("what"), understanding.alias("understanding"), F.coalesce("synthesised", "updated").alias("updated"))
    return rows.orderBy("name")
