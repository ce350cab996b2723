"""Dialogue: parsing, context windows, chat examples, splits, validation and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..columns import counted, fresh, median
from ..functions.scoring import verdict, vote, without_vote
from ..functions.text import clean_dialogue, pick_template, stem_key, strip, token_estimate, words

QUOTE = "[\"“](.+?)[\"”]"
#: Headings that mark a biography.
PROFILE_SIGNALS = ["character overview", "personality traits", "speech style", "cultural legacy", "key relationships", "iconic moments"]


def chunks(docs: DataFrame, file: str, text: str = "text", size: int = 300, overlap: int = 50) -> DataFrame:
    """Overlapping word chunks: (source_file, chunk_index, chunk_id, text). The last one reaches the end."""
    step = size - overlap
    own = docs.select(F.col(file).alias("source_file"), words(F.col(text)).alias("ws"))
    count = F.greatest(F.lit(0), F.ceil((F.size("ws") - size) / float(step))).cast("int")
    # A filter on the words would cut every text twice; exploding null drops the row.
    cut = own.withColumn("chunk_index", F.explode(F.when(F.size("ws") > 0, F.sequence(F.lit(0), count))))
    return cut.select("source_file", "chunk_index", F.concat("source_file", F.lit("::"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.array_join(F.slice("ws", F.col("chunk_index") * step + 1, size), " ").alias("text"))


def context_window(dialogue: DataFrame, k: int = 3) -> DataFrame:
    """Each line with the k lines before it in its source, as "character: line" rows."""
    before = Window.partitionBy("source").orderBy("pos").rowsBetween(-k, -1)
    line = F.concat("character", F.lit(": "), "dialogue")
    return dialogue.withColumn("context", F.array_join(F.collect_list(line).over(before), "\n"))


def history(messages: DataFrame, by: str, order: str) -> DataFrame:
    """Each message with all messages of its conversation up to it."""
    until = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("history", F.array_join(F.collect_list(F.concat("character", F.lit(": "), "dialogue")).over(until), "\n"))


def chat_examples(dialogue: DataFrame, prompts: DataFrame, k: int = 3) -> DataFrame:
    """system, user and assistant message of each line whose character has a system prompt.

    ``prompts`` has (character, system) and is a small dimension.
    """
    key = F.concat_ws(":", F.col("source").cast("string"), F.col("pos").cast("string"))
    generic = pick_template(key, schemas.PROMPT_TEMPLATES, "a new proposal being discussed")
    user = F.when(F.col("context") != "", F.concat(F.lit("The conversation so far:\n"), "context", F.lit("\n\nHow do you respond?"))).otherwise(generic)
    return context_window(dialogue, k).join(prompts, "character").select("source", "pos", F.col("system"), user.alias("user"), F.col("dialogue").alias("assistant"))


def single_turn_examples(dialogue: DataFrame, prompts: DataFrame) -> DataFrame:
    key = F.concat_ws(":", F.col("source").cast("string"), F.col("pos").cast("string"))
    return dialogue.join(prompts, "character").select("source", "pos", "system", pick_template(key, schemas.PROMPT_TEMPLATES, "a new business idea").alias("user"), F.col("dialogue").alias("assistant"))


def as_messages(examples: DataFrame) -> DataFrame:
    one = lambda role: F.struct(F.lit(role).alias("role"), F.col(role).alias("content"))
    return examples.select(F.array(one("system"), one("user"), one("assistant")).alias("messages"))


def split_order(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key))


def split(examples: DataFrame, key: Column, percent: int = 10, seed: int = 42) -> DataFrame:
    """``part`` val or train by a hash of the key: the same row always falls on the same side.

    The share is ``percent`` in expectation. Fixing the first n of a global order would
    take one sort of everything; a threshold takes none.
    """
    at = F.conv(F.substring(split_order(key, seed), 1, 8), 16, 10).cast("long") % 100
    return examples.withColumn("part", F.when(at < percent, "val").otherwise("train"))


def sample_per_class(rows: DataFrame, by: str, key: Column, n: int, seed: int = 42) -> DataFrame:
    """Up to n rows of each class, first in the seeded order."""
    order = Window.partitionBy(by).orderBy(split_order(key, seed))
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def length_stats(rows: DataFrame, by: str, text: str) -> DataFrame:
    """Count, and average, least and most estimated tokens and characters, of each class."""
    t, n = token_estimate(F.col(text)), F.length(text).cast("long")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("cnt"), F.round(F.avg(t), 6).alias("avg_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"), F.round(F.avg(n), 6).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))


def sequence_stats(rows: DataFrame, tokens: Column, limit: int = 2048) -> DataFrame:
    """Average, least, most and median number of tokens, and how many rows have more than ``limit``."""
    middle = median(rows, tokens)
    return rows.select(tokens.alias("t")).agg(F.round(F.avg("t"), 6).alias("avg_tokens"), F.min("t").alias("min_tokens"), F.max("t").alias("max_tokens"), F.lit(middle).cast("double").alias("median_tokens"), F.count_if(F.col("t") > limit).alias("too_long"))


def duplicate_groups(rows: DataFrame, text: str) -> DataFrame:
    """Texts that occur more than once. The text itself crosses the network only as its digest."""
    return rows.groupBy(F.sha2(F.col(text), 256).alias("text_sha")).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


def class_balance(rows: DataFrame, by: str) -> DataFrame:
    """Ratio of the largest to the smallest class and what it means."""
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.min("n").alias("least"))
    ratio = F.col("most") / F.col("least")
    return sizes.select("most", "least", F.round(ratio, 6).alias("ratio"), F.when(ratio > 5, "imbalanced").when(ratio > 2, "moderate").otherwise("balanced").alias("verdict"))


def gap_plan(have: DataFrame, wanted: DataFrame, by: str, target: int) -> DataFrame:
    """What each wanted class has and needs, those below the target only."""
    counts = have.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, by, "left").select(by, F.coalesce("n", F.lit(0)).cast("long").alias("have")).where(F.col("have") < target).withColumn("need", F.lit(target) - F.col("have"))


def missing(wanted: DataFrame, have: DataFrame, by: str) -> DataFrame:
    return wanted.select(by).distinct().join(have.select(by), by, "left_anti")


def cycle_pick(wanted: DataFrame, n: str, scenarios: DataFrame) -> DataFrame:
    """For each row of ``wanted`` its ``n`` scenarios in turn, from the start again when they run out."""
    total = scenarios.select(F.count(F.lit(1)).over(Window.partitionBy()).alias("total"), F.col("ord"), F.col("value"))
    turns = wanted.where(F.col(n) > 0).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)))
    return turns.join(counted(total), F.expr("turn % total = ord")).drop("total", "ord")


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """One profile per character: lists joined, the first style that isn't empty, descriptions by blank lines."""
    ordered = profiles.groupBy("character").agg(F.array_sort(F.collect_list(F.struct("source", "personality_traits", "speech_style", "iconic_lines", "raw_description"))).alias("p"))
    styles = F.filter(F.transform("p", lambda x: x["speech_style"]), lambda s: F.coalesce(s, F.lit("")) != "")
    return ordered.select("character", F.flatten(F.transform("p", lambda x: x["personality_traits"])).alias("personality_traits"), F.coalesce(F.get(styles, 0), F.lit("")).alias("speech_style"), F.flatten(F.transform("p", lambda x: x["iconic_lines"])).alias("iconic_lines"), F.array_join(F.transform("p", lambda x: x["raw_description"]), "\n\n").alias("raw_description"))


def votes(messages: DataFrame, text: str) -> DataFrame:
    return messages.withColumns({"vote": vote(F.col(text)), "content": without_vote(F.col(text))})


def tally(voted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """yes, no, abstain, their shares in percent and the verdict."""
    counts = (voted.groupBy(*by) if by else voted.groupBy()).agg(*[F.count_if(F.col("vote") == v).alias(v) for v in ("yes", "no", "abstain")])
    total = F.greatest(F.col("yes") + F.col("no") + F.col("abstain"), F.lit(1))
    return counts.withColumns({f"{v}_percent": F.round(F.col(v) * 100.0 / total, 4) for v in ("yes", "no", "abstain")} | {"verdict": verdict(F.col("yes"), F.col("no"))})


def classify_file(stem: Column, content: Column) -> Column:
    """script, quotes or profile, by what a file's start shows."""
    head = F.lower(F.substring(content, 1, 3000))
    signals = sum((F.contains(head, F.lit(s)).cast("int") for s in PROFILE_SIGNALS), F.lit(0))
    body = F.substring(content, 1, 5000)
    count = lambda p: F.size(F.regexp_extract_all(body, F.lit(p), F.lit(0)))
    quotes, lines, wiki = count("[\"“].{15,}?[\"”]"), count(r"(?m)^[A-Z][A-Z\s\.]+:\s*.+"), count(r"\[\[.+?\]\]|\[\d+\]")
    return (
        F.when(signals >= 2, "profile")
        .when((quotes >= 5) & F.contains(F.lower(stem), F.lit("quote")), "quotes")
        .when((lines >= 5) | ((lines >= 2) & (wiki >= 3)), "script")
        .when(quotes >= 5, "quotes")
        .when((wiki >= 10) & (lines < 3), "profile")
        .when(signals >= 1, "profile")
        .otherwise("script")
    )


def parse_script(files: DataFrame, aliases: DataFrame, least: int = 10) -> DataFrame:
    """Lines "Name: text" of known characters: (source, pos, character, dialogue).

    ``aliases`` is a small dimension (alias, character), matched on the lower-cased name.
    """
    pattern = r"(?m)^([A-Z][A-Za-z\s\.]+?):\s*(.+?)$"
    each = lambda g: F.regexp_extract_all("content", F.lit(pattern), F.lit(g))
    found = files.select("source", F.posexplode(F.arrays_zip(each(1).alias("name"), each(2).alias("line"))).alias("pos", "m"))
    named = found.select("source", "pos", F.lower(F.trim("m.name")).alias("alias"), clean_dialogue(F.col("m.line")).alias("dialogue"))
    return named.where(F.length("dialogue") > least).join(counted(aliases), "alias").select("source", "pos", "character", "dialogue")


def parse_blocks(files: DataFrame, aliases: DataFrame, least: int = 10) -> DataFrame:
    """The other script form: a known name alone on a line, then lines up to a blank one or the next name."""
    rows = files.select("source", F.posexplode(F.split("content", "\n")).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    named = rows.join(counted(aliases), F.lower("line") == F.col("alias"), "left")
    order = Window.partitionBy("source").orderBy("pos")
    marked = named.withColumn("opens", F.sum(F.when(F.col("character").isNotNull() | (F.col("line") == ""), 1).otherwise(0)).over(order))
    block = marked.groupBy("source", "opens").agg(F.min("pos").alias("pos"), F.max("character").alias("character"), F.array_sort(F.collect_list(F.when(F.col("character").isNull(), F.struct("pos", "line")))).alias("ls"))
    said = block.where("character IS NOT NULL").withColumn("dialogue", clean_dialogue(F.array_join(F.transform("ls", lambda x: x["line"]), " ")))
    return said.where(F.length("dialogue") > least).select("source", "pos", "character", "dialogue")


def parse_quotes(files: DataFrame, least: int = 10, least_plain: int = 15) -> DataFrame:
    """Quoted strings of files that belong to one character: (source, pos, character, dialogue).

    Quotes behind the character's first name come first, then numbered ones that aren't
    among these; only where there are neither, all quotes count.
    """
    tidy = lambda qs, n: F.filter(F.transform(qs, lambda q: strip(F.regexp_replace(q, r"\s+", " "))), lambda q: F.length(q) > n)
    named = F.concat(F.lit(r"(?s)"), F.split("character", " ")[0], F.lit(r":\s*(?:\(.*?\)\s*)?" + QUOTE))
    said = tidy(F.regexp_extract_all("content", named, F.lit(1)), least)
    numbered = tidy(F.regexp_extract_all("content", F.lit(r"(?s)(?:^|\n)\s*\d+\.\s*" + QUOTE), F.lit(1)), least)
    plain = tidy(F.regexp_extract_all("content", F.lit("(?s)" + QUOTE), F.lit(1)), least_plain)
    both = files.select("source", "character", said.alias("said"), numbered.alias("numbered"), plain.alias("plain"))
    told = F.concat("said", F.filter("numbered", lambda q: ~F.array_contains("said", q)))
    return both.select("source", "character", F.posexplode(F.when(F.size(told) > 0, told).otherwise(F.col("plain"))).alias("pos", "dialogue"))


def parse_monologue(files: DataFrame, least: int = 20) -> DataFrame:
    """Files in which every line is the one character's: (source, pos, character, dialogue)."""
    lines = files.select("source", "character", F.posexplode(F.split("content", "\n")).alias("pos", "raw")).withColumn("line", strip(F.col("raw")))
    heading = F.lower("line").rlike("^(character overview|personality|speech style|cultural legacy|iconic moments)")
    return lines.where((F.length("line") >= least) & ~heading).withColumn("dialogue", clean_dialogue(F.col("line"))).where(F.length("dialogue") > least).select("source", "pos", "character", "dialogue")


#: Headings at which a biography is cut.
SECTION_HEADS = ["Character Overview", "Personality Traits", "Speech Style", "Iconic Moments", "Key Relationships", "Cultural Legacy", "Dialogues and Speech Style", "Character biography", "His Relationship", "Her Relationship"]


def parse_profile(files: DataFrame) -> DataFrame:
    """A profile per biography: traits, speech style and lines by section, else a general description."""
    sections = F.split("content", r"(?i)\n(?=(?:" + "|".join(SECTION_HEADS) + "))")
    cut = files.select("source", "character", "content", F.transform(sections, lambda x: F.struct(F.lower(F.substring(x, 1, 50)).alias("head"), x.alias("body"))).alias("parts"))
    about = lambda x, *words: sum((F.contains(x["head"], F.lit(w)).cast("int") for w in words), F.lit(0)) > 0
    kind = lambda x: F.when(about(x, "personality"), "traits").when(about(x, "speech style", "dialogues and speech"), "style").when(about(x, "iconic moments"), "lines").when(about(x, "character biography"), "life").otherwise("")
    trait = r"(?:^|\n)(.+?)\s*[-–—]+\s*(.+?)(?=\n|$)"
    each = lambda x, g: F.regexp_extract_all(x["body"], F.lit(trait), F.lit(g))
    pairs = lambda x: F.transform(F.filter(F.arrays_zip(each(x, 1).alias("name"), each(x, 2).alias("what")), lambda t: F.length(strip(t["what"])) > 10), lambda t: F.concat(strip(t["name"]), F.lit(": "), strip(t["what"])))
    life = lambda x: F.array(F.concat(F.lit("Character biography: "), strip(F.substring(x["body"], 1, 500))))
    traits = F.flatten(F.transform("parts", lambda x: F.when(kind(x) == "traits", pairs(x)).when(kind(x) == "life", life(x)).otherwise(F.array().cast("array<string>"))))
    styles = F.filter(F.transform("parts", lambda x: F.when(kind(x) == "style", strip(F.regexp_replace(strip(x["body"]), r"^[^\n]*\n?", "")))), lambda t: t.isNotNull())
    quoted = F.filter(F.transform(F.flatten(F.transform("parts", lambda x: F.when(kind(x) == "lines", F.regexp_extract_all(x["body"], F.lit(QUOTE), F.lit(1))).otherwise(F.array().cast("array<string>")))), strip), lambda q: F.length(q) > 10)
    found = cut.select("source", "character", "content", traits.alias("t"), F.coalesce(F.try_element_at(styles, F.lit(-1)), F.lit("")).alias("speech_style"), quoted.alias("iconic_lines"))
    general = F.array(F.concat(F.lit("General description: "), strip(F.substring("content", 1, 1000))))
    return found.select("character", F.when((F.size("t") == 0) & (F.col("speech_style") == ""), general).otherwise(F.col("t")).alias("personality_traits"), "speech_style", "iconic_lines", F.substring("content", 1, 5000).alias("raw_description"), "source")


def counts_by_prompt(examples: DataFrame, characters: DataFrame, prompt: str = "system") -> DataFrame:
    """Examples per character, found as the first of ``characters`` (ord, character) that the prompt contains.

    Characters are a constant dimension; prompts are counted before the two are matched.
    """
    prompts = examples.groupBy(prompt).agg(F.count(F.lit(1)).alias("n"))
    found = prompts.join(counted(characters), F.contains(F.col(prompt), F.col("character"))).groupBy(prompt, "n").agg(F.min_by("character", "ord").alias("character"))
    return found.groupBy("character").agg(F.sum("n").alias("cnt"))


def hinted(files: DataFrame, hints: DataFrame) -> DataFrame:
    """Each file with the character of the hint (ord, hint, character) that equals its stem, else of the first
    by ord that the stem contains or is contained in.

    The hints are counted before they are broadcast. Distinct stems are matched, so no
    contents are moved.
    """
    key = F.lower("stem")
    either = F.contains(F.col("key"), F.col("hint")) | F.contains(F.col("hint"), F.col("key"))
    same = F.when(F.col("key") == F.col("hint"), 0).otherwise(1)
    found = files.select(key.alias("key")).distinct().join(counted(hints), either).groupBy("key").agg(F.min_by("character", F.struct(same, F.col("ord"))).alias("hinted"))
    name = fresh("stem_key", files)
    return files.withColumn(name, key).join(found.withColumnRenamed("key", name), name, "left").withColumn("character", F.col("hinted")).drop(name, "hinted")


def parse_files(files: DataFrame, aliases: DataFrame, hints: DataFrame, monologue: str = "miranda_quotes") -> tuple[DataFrame, DataFrame]:
    """(dialogue, profiles) of files (source, stem, content): each by the parser that its kind asks for.

    Biographies give a profile and their lines as dialogue; quote files and files without
    labels belong to the character that a hint names, "Unknown" where none does; scripts
    are read line by line, and by blocks where that finds nothing.
    """
    known = hinted(files.where(F.length("content") > 0).withColumn("stem", stem_key(F.col("stem"))), hints)
    kinds = known.withColumns({"kind": classify_file(F.col("stem"), F.col("content")), "character": F.coalesce("character", F.lit("Unknown"))})
    of = lambda kind: kinds.where(F.col("kind") == kind)
    profiles = parse_profile(of("profile"))
    iconic = profiles.select("source", F.posexplode("iconic_lines").alias("pos", "dialogue"), "character")
    one_voice = F.contains(F.lower("stem"), F.lit(monologue))
    scripts = of("script").where(~one_voice)
    lines = parse_script(scripts, aliases)
    blocks = parse_blocks(scripts.join(lines.select("source").distinct(), "source", "left_anti"), aliases)
    out = None
    for part in (iconic, parse_quotes(of("quotes")), parse_monologue(of("script").where(one_voice)), lines, blocks):
        part = part.select("source", "pos", "character", "dialogue")
        out = part if out is None else out.unionByName(part)
    return out, profiles


def line_counts(dialogue: DataFrame, wanted: DataFrame, low: int = 30) -> DataFrame:
    """(character, cnt, status) for every wanted character: MISSING without a line, LOW under ``low``, else OK."""
    counts = dialogue.groupBy("character").agg(F.count(F.lit(1)).alias("n"))
    both = wanted.select("character").join(counts, "character", "left").select("character", F.coalesce("n", F.lit(0)).cast("long").alias("cnt"))
    return both.withColumn("status", F.when(F.col("cnt") == 0, "MISSING").when(F.col("cnt") < low, "LOW").otherwise("OK"))


def duplicate_report(rows: DataFrame, text: str, most: int = 5) -> DataFrame:
    """(text_sha, cnt, groups, rn): the commonest texts that repeat, and how many such texts there are."""
    groups = duplicate_groups(rows, text)
    total = groups.agg(F.count(F.lit(1)).alias("groups"))
    top = groups.orderBy(F.desc("cnt"), "text_sha").limit(most)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("cnt"), "text_sha"))).join(F.broadcast(total))  # ``most`` rows, one row


def reactions(pitches: DataFrame, model, least: int = 1) -> DataFrame:
    """(character, value, reply) of a model hook on (system, value); rows without a reply go."""
    from ..functions import hooks

    return pitches.withColumn("reply", hooks.on_question(model)("system", "value")).where(F.length("reply") >= least)
