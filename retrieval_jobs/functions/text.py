"""Column functions over strings, JSON, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME_CHARS = 15

ENTITY = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "label", "description")])
RELATION = T.StructType([T.StructField(c, T.StringType()) for c in ("head", "tail", "type")])
EXTRACTION = T.StructType([T.StructField("entities", T.ArrayType(ENTITY)), T.StructField("relations", T.ArrayType(RELATION)), T.StructField("_bad", T.StringType())])


def strip(c: Column) -> Column:
    """Without leading and trailing white space, line breaks included."""
    return F.regexp_replace(c, r"^[\s]+|[\s]+$", "")


def filled(c: Column) -> Column:
    """The stripped text, or null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def normalize_newlines(c: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(c, "\r\n|\r", "\n")


def embedding_text(head: Column, body: Column) -> Column:
    """Text to embed: item name over chunk content, or question over hypothetical document."""
    return F.concat_ws("\n", head, body)


def chunk_key(c: Column) -> Column:
    """Chunk ids are long in chunk tables and text in the graph; joins use text."""
    return c.cast("string")


def object_url(doc: Column, image: Column, endpoint: str, bucket: str, secure: bool = False) -> Column:
    return F.concat_ws("/", F.lit(f"{'https' if secure else 'http'}://{endpoint}"), F.lit(bucket), doc, image)


def unfenced(c: Column) -> Column:
    """A model response without its code fence."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"^```(json)?[ \t\n]*", ""), r"[ \t\n]*```$", "")


def parse_extraction(response: Column) -> Column:
    """Struct (status, entities, relations): ``ok``, or ``error`` for blank and invalid JSON; missing lists are empty."""
    parsed = F.from_json(unfenced(response), EXTRACTION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = filled(response).isNull() | parsed.isNull() | parsed["_bad"].isNotNull()
    none_e, none_r = F.lit(None).cast(T.ArrayType(ENTITY)), F.lit(None).cast(T.ArrayType(RELATION))
    pick = lambda part, none: F.coalesce(F.when(~bad, parsed[part]).otherwise(none), F.array().cast(none_e_type(part)))
    return F.struct(F.when(bad, "error").otherwise("ok").alias("status"), pick("entities", none_e).alias("entities"), pick("relations", none_r).alias("relations"))


def none_e_type(part: str) -> T.DataType:
    return T.ArrayType(ENTITY if part == "entities" else RELATION)


def parse_query_entities(response: Column) -> Column:
    """Entity names of a question: strings, trimmed, cut to 15 characters, in order, once each; blanks go."""
    names = F.from_json(unfenced(response), "entities array<string>")["entities"]
    names = F.transform(names, lambda n: F.substring(strip(n), 1, NAME_CHARS))
    return F.coalesce(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != ""))), F.array().cast("array<string>"))


def parse_item_names(response: Column, query: Column) -> Column:
    """Struct (item_names, rewritten_query): names without blanks; the question itself if parsing fails."""
    parsed = F.from_json(unfenced(response), "item_names array<string>, rewritten_query string")
    names = F.filter(F.transform(parsed["item_names"], strip), lambda n: n.isNotNull() & (n != ""))
    return F.struct(F.coalesce(names, F.array().cast("array<string>")).alias("item_names"), F.coalesce(filled(parsed["rewritten_query"]), query).alias("rewritten_query"))


def triples_to_text(item: Column, head: Column, rel: Column, tail: Column) -> Column:
    """``[item] head -(rel)-> tail``; the item is left out if blank; null if an end or the relation is blank."""
    body = F.concat(filled(head), F.lit(" -("), filled(rel), F.lit(")-> "), filled(tail))
    return F.concat(F.coalesce(F.concat(F.lit("["), filled(item), F.lit("] ")), F.lit("")), body)


@F.udf(T.StringType())
def four_digits(x):
    return None if x is None else f"{x:.4f}"


def format_doc(number: Column, source: Column, chunk_id: Column, url: Column, title: Column, score: Column, content: Column) -> Column:
    """Tags in brackets, a line break, the content; empty tags are left out.

    A score is rounded by its exact binary value (0.01635 is 0.0163), as printf does, by Python: Java's ``%.4f`` rounds its shortest digits (0.0164)."""
    tag = lambda name, c: F.concat(F.lit(f"[{name}="), filled(c.cast("string")), F.lit("]"))
    shown = F.concat(F.lit("[score="), four_digits(score), F.lit("]"))
    tags = F.concat_ws(" ", F.concat(F.lit("["), number.cast("string"), F.lit("]")), tag("source", source), tag("chunk_id", chunk_id), tag("url", url), tag("title", title), F.when(score.isNotNull(), shown))
    return F.concat(tags, F.lit("\n"), strip(content))


def history_line(role: Column, text: Column, labels: dict[str, str] | None = None) -> Column:
    """``role: text``. Without labels the text is stripped, blank texts give null and a missing role is empty; with labels, other roles
    and empty texts give null."""
    if labels is None:
        return F.concat(F.coalesce(role, F.lit("")), F.lit(": "), filled(text))
    shown = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[role]
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(shown, F.lit(": "), text))


# What may stand right before and after an address in a text and is no part of it.
BEFORE_URL = "<([{'\"＜（【"
AFTER_URL = ")]}'\">，。,;；】）＞"


def answer_images(answer: Column) -> Column:
    """Struct (text, images): text before the last image marker, and the image addresses after it and in the text."""
    # The marker, address and suffix patterns
    marker, address, suffix = r"(?s)^(.*)(?:【\s*图片\s*】|\[\s*图片\s*\])(.*)$", r"https?://[^\s]+", r"(?i)\.(png|jpe?g|gif|webp|bmp|svg)(\?|#|$)"
    answer = F.coalesce(answer, F.lit(""))
    marked = answer.rlike(marker)
    before = F.when(marked, F.regexp_replace(F.regexp_extract(answer, marker, 1), r"\s+$", "")).otherwise(answer)
    after = F.when(marked, strip(F.regexp_extract(answer, marker, 2))).otherwise("")
    tidy = lambda u: F.ltrim(F.rtrim(u, F.lit(AFTER_URL)), F.lit(BEFORE_URL))
    loose = lambda c: F.transform(F.regexp_extract_all(c, F.lit(address), F.lit(0)), tidy)
    lines = F.transform(F.split(after, r"\r?\n"), strip)
    block = F.flatten(F.transform(lines, lambda x: F.when(x.rlike("^https?://"), F.array(x)).otherwise(loose(x))))
    urls = F.transform(F.concat(block, loose(answer)), lambda u: F.regexp_replace(strip(u), r"\s", "%20"))
    return F.struct(before.alias("text"), F.array_distinct(F.filter(urls, lambda u: u.rlike(suffix))).alias("images"))


def sparse_row(indices: Column, data: Column, indptr: Column, row: Column) -> Column:
    """Row of a compressed sparse matrix as a map token -> weight."""
    at, size = F.element_at(indptr, row + 1), F.element_at(indptr, row + 2) - F.element_at(indptr, row + 1)
    return F.map_from_arrays(F.slice(indices, at + 1, size), F.slice(data, at + 1, size))
