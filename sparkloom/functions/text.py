"""Scalar text functions, Column to Column, all inside the JVM.

Word characters are Unicode letters, digits and the underscore throughout: Java's
and DuckDB's own ``\\w`` are ASCII, so the class is spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"


def strip(text: Column) -> Column:
    """All white space off both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """White-space separated words, none of them empty."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def clean_text(text: Column) -> Column:
    """URLs and all but ASCII letters become spaces; lower case, stripped."""
    return strip(F.lower(F.regexp_replace(F.regexp_replace(text, r"http\S+", " "), r"[^a-zA-Z\s]", " ")))


def build_text(title: Column, body: Column, limit: int = 2048) -> Column:
    """Title and body for a classifier; a null counts as empty."""
    joined = F.substring(strip(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))), 1, limit)
    return F.when(joined == "", F.lit("no content")).otherwise(joined)


def joined_text(title: Column, body: Column) -> Column:
    """Title and body as stored content: null where the title is null."""
    return F.concat(title, F.lit(" "), F.coalesce(body, F.lit("")))


def html_to_text(html: Column, least: int = 100, most: int = 8000) -> Column:
    """Scripts, styles, tags and named entities out, long gaps to blank lines; null if short."""
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"<[^>]+>", r"&[a-z]+;"):
        html = F.regexp_replace(html, pattern, " ")
    text = strip(F.regexp_replace(html, r"\s{3,}", "\n\n"))
    return F.when(F.length(text) >= least, F.substring(text, 1, most))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_\-]", "_"), r"^_+|_+$", "")


def url_name(name: Column) -> Column:
    return F.url_encode(F.replace(name, F.lit(" "), F.lit("_")))


#: Least length of a fetched extract.
MIN_EXTRACT = 50


def fetch_title(name: Column, overrides: dict[str, str | None]) -> Column:
    """The title to look a concept up under, null where there is nothing to fetch: names with a slash,
    names of one or two characters, and those that ``overrides`` maps to None."""
    known = F.lit(False)
    title = name
    for key, value in overrides.items():
        known = known | (name == key) if value is None else known
        title = F.when(name == key, value).otherwise(title) if value is not None else title
    return F.when(fetchable(name) & ~known, title)


def usable_extract(text: Column) -> Column:
    """A fetched extract, null where it is too short to keep."""
    return F.when(F.length(strip(text)) >= MIN_EXTRACT, text)


def fetchable(name: Column) -> Column:
    """Names that an encyclopedia lookup can take."""
    return ~F.contains(name, F.lit("/")) & (F.length(name) > 2)


def acronym(name: Column) -> Column:
    """First letters of a name's words, lower case; null unless there are two words and two letters."""
    parts = F.split(name, r"[\s\-_]+")
    letters = F.lower(F.array_join(F.transform(parts, lambda w: F.substring(w, 1, 1)), ""))
    return F.when((F.size(parts) >= 2) & (F.length(letters) >= 2), letters)


def first_sentence(text: Column) -> Column:
    """Up to the first full stop and space, with a full stop added (also to one that has it)."""
    return F.concat(F.split(text, r"\. ")[0], F.lit("."))


def clean_dialogue(text: Column) -> Column:
    """Image tags, wiki links and stage directions out; white space collapsed."""
    for pattern, to in ((r"\[\[File:.*?\]\]", ""), (r"\[\[([^|\]]*?\|)?(.+?)\]\]", "$2"), (r"\[.*?\]", ""), (r"\(.*?\)", "")):
        text = F.regexp_replace(text, pattern, to)
    return collapse_spaces(text)


def truncate_words(text: Column, most: int = 400) -> Column:
    own = words(text)
    return F.when(F.size(own) <= most, text).otherwise(F.concat(F.array_join(F.slice(own, 1, most), " "), F.lit("...")))


def truncate_chars(text: Column, most: int, end: str = "…") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(end))).otherwise(text)


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def stem_key(stem: Column) -> Column:
    return F.regexp_replace(stem, r"[\s.]+", "_")


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(strip(text), r'^"+|"+$', "")


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def lighten(color: Column, amount: float) -> Column:
    """Each channel of #rrggbb moved towards 255."""

    def channel(at: int) -> Column:
        value = F.conv(F.substring(color, at, 2), 16, 10).cast("int")
        return F.lpad(F.lower(F.hex((value + (255 - value) * amount).cast("int"))), 2, "0")

    return F.concat(F.lit("#"), channel(2), channel(4), channel(6))


def node_size(score: Column, most: Column) -> Column:
    return F.lit(15) + (score / most * 35).cast("int")


def json_object(text: Column, schema: str, greedy: bool = True) -> Column:
    """The first JSON object in free text; null if there is none or it doesn't parse."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}" if greedy else r"(?s)\{.*?\}", 0), schema)


def xml_elements(text: Column, tag: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def character_of(prompt: Column) -> Column:
    """The name in "You are X from ..." or else "You are X. ..."."""
    return F.coalesce(*[F.nullif(F.regexp_extract(prompt, rf"(?s)^You are (.*?){end}", 1), F.lit("")) for end in (" from", r"\. ")])


def concept_document(name: Column, definition: Column, category: Column, difficulty: Column, uses: Column) -> Column:
    """The text of a concept that goes into the vector index."""
    listed = F.coalesce(F.array_join(uses, ", "), F.lit(""))
    return F.concat_ws("\n", name, F.coalesce(definition, F.lit("")), F.concat(F.lit("Category: "), category), F.concat(F.lit("Difficulty: "), difficulty), F.concat(F.lit("Use cases: "), listed))


def from_epoch(seconds: Column) -> Column:
    """The time that a number of seconds since 1970 stands for."""
    return F.timestamp_seconds(seconds)


def seed_document(name: Column, category: Column, difficulty: Column, definition: Column, uses: Column, tools: Column, refs: Column) -> Column:
    """A corpus file made of a concept alone; null without a definition."""
    lines = lambda head, xs, line, gap: F.when(F.size(xs) > 0, F.concat(F.lit(head), F.array_join(F.transform(xs, lambda x: F.concat(F.lit(line), x)), gap)))
    return F.when(
        F.coalesce(definition, F.lit("")) != "",
        F.concat_ws("\n", F.concat(F.lit("# "), name), F.concat(F.lit("\nCategory: "), F.coalesce(category, F.lit("")), F.lit(" | Difficulty: "), F.coalesce(difficulty, F.lit(""))), F.lit("\nSource: Seed knowledge base\n"), F.concat(F.lit("\n## Definition\n\n"), definition), lines("\n## Example Use Cases\n\n", uses, "- ", "\n"), lines("\n## Related Tools\n\n", tools, "", ", "), lines("\n## References\n\n", refs, "- ", "\n")),
    )


def profile_text(traits: Column, description: Column, lines: Column) -> Column:
    """Up to 8 traits, 500 characters of description and 5 lines."""
    some = lambda head, xs, gap: F.when(F.size(xs) > 0, F.concat(F.lit(head), F.array_join(xs, gap)))
    return F.concat_ws("\n", some("Personality: ", F.slice(traits, 1, 8), ", "), F.when(F.length(description) > 0, F.concat(F.lit("Background: "), F.substring(description, 1, 500))), some("Lines: ", F.slice(lines, 1, 5), " | "))


def render_chat(messages: Column) -> Column:
    """Messages (role, content) in the header-and-end-mark template of instruction models."""
    turns = F.transform(messages, lambda m: F.concat(F.lit("<|start_header_id|>"), m["role"], F.lit("<|end_header_id|>\n\n"), m["content"], F.lit("<|eot_id|>")))
    return F.concat(F.lit("<|begin_of_text|>"), F.array_join(turns, ""))


def pick_template(key: Column, templates: list[str], context: str) -> Column:
    """A template chosen by a hash of the row's key: the same row always gets the same one."""
    at = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % len(templates)
    return F.element_at(F.array(*[F.lit(t + context) for t in templates]), (at + 1).cast("int"))
