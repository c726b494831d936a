"""Column functions on text: ids, tokens, names, sentences, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word characters, in classes that mean the same to Java and RE2: only Java's \s holds the vertical tab.
SPACE = r"[\t\n\f\r\p{Z}]"
NOT_TOKEN = r"[^\p{L}\p{N}_\t\n\f\r\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"
NAME_LENGTH = 256


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends (Java's $ would also match before a last line terminator)."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def is_blank(c: Column) -> Column:
    """Whether there is white space alone; null for null."""
    return ~c.rlike(SPACE.replace("[", "[^", 1))


def hash_id(c: Column, prefix: str = "") -> Column:
    """The MD5 of the text in hex, after a prefix."""
    return F.concat(F.lit(prefix), F.md5(c))


def document_id(content: Column, path: Column) -> Column:
    """doc- and the MD5 of the content, or of the path where there is none."""
    return hash_id(F.when(empty_if_null(content) == "", empty_if_null(path)).otherwise(content), "doc-")


def tokens(c: Column) -> Column:
    """White-space separated tokens; null has none."""
    return F.filter(F.split(empty_if_null(c), r"[ \t\n\r\f]+"), lambda w: w != "")


def lexical_tokens(c: Column) -> Column:
    """Lower-cased tokens without punctuation or combining marks, repeats kept."""
    return F.filter(F.split(F.regexp_replace(F.lower(empty_if_null(c)), NOT_TOKEN, ""), rf"{SPACE}+"), lambda w: w != "")


def token_line(c: Column) -> Column:
    """lexical_tokens() parted by single spaces; one more may stand at either end."""
    return F.regexp_replace(F.regexp_replace(F.lower(empty_if_null(c)), NOT_TOKEN, ""), rf"{SPACE}+", " ")


def word_set(c: Column) -> Column:
    """Distinct words of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(empty_if_null(c)), F.lit(f"({WORD})"), F.lit(1)))


def entity_name(c: Column) -> Column:
    """Stripped, each letter after a non-letter upper-cased and the others lowered, at most NAME_LENGTH characters.

    Unlike initcap(), an apostrophe, hyphen or digit starts a new run of letters.
    """
    runs = F.split(F.lower(strip(c)), r"(?<=[^\p{L}])(?=\p{L})")
    titled = F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.substring(F.array_join(titled, ""), 1, NAME_LENGTH)


def sentences(c: Column) -> Column:
    """Pieces after . ! or ? and white space, stripped, none empty."""
    pieces = F.split(empty_if_null(c), rf"(?<=[.!?]){SPACE}+")
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def entity_text(name: Column, description: Column, kind: Column | None = None) -> Column:
    """`name: description`, with the type in brackets for the lexical index."""
    return F.concat(name, F.lit(": "), description) if kind is None else F.concat(name, F.lit(" ("), kind, F.lit("): "), description)


def relation_text(src: Column, tgt: Column, description: Column) -> Column:
    return F.concat(src, F.lit(" -> "), tgt, F.lit(": "), description)


def stripped_lines(c: Column, separator: str = "\n") -> Column:
    """Pieces between separators, stripped; null has none."""
    return F.transform(F.split(c, f"\\Q{separator}\\E"), strip)


def unique_lines(c: Column, separator: str = "\n") -> Column:
    """Pieces between separators, stripped, each once in the order of first sight."""
    return F.array_join(F.array_distinct(F.filter(stripped_lines(c, separator), lambda x: x != "")), separator)


def merge_descriptions(parts: Column, strategy: str = "join_unique") -> Column:
    """An array of descriptions as one: concatenate (a line each), keep_first, join_unique (each line once)."""
    if strategy == "keep_first":
        return F.get(parts, F.lit(0))
    joined = F.array_join(parts, "\n")
    if strategy in ("concatenate", "confidence_weighted"):
        return joined
    if strategy != "join_unique":
        raise ValueError(f"unknown strategy {strategy}")
    return unique_lines(joined)


def same_place_similarity(a: Column, b: Column) -> Column:
    """Characters equal at the same place, as a share of the longer text; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    same = F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: p["x"] == p["y"]))
    return F.when(longest == 0, F.lit(1.0)).otherwise(same / longest)


def workspace_name(workspace: Column, namespace: Column) -> Column:
    return F.concat_ws("/", F.when(workspace != "", workspace), namespace)


def confidence(c: Column) -> Column:
    """A number in [0, 1]; what can't be read is 0.5."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(0.5))))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def as_messages(system: Column, user: Column, assistant: Column) -> Column:
    """Chat messages with a role each; null parts are left out."""
    each = [F.when(c.isNotNull(), F.struct(F.lit(role).alias("role"), c.alias("content"))) for role, c in (("system", system), ("user", user), ("assistant", assistant))]
    return F.array_compact(F.array(*each))


def timestamp(c: Column) -> Column:
    """An ISO-8601 text as a timestamp; null where it can't be read."""
    return F.try_to_timestamp(c)
