"""Access control, prompt injection, personal data, and cleaned output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import empty_if_null, strip

# Injection patterns of the first detector, searched in the lower-cased text.
INJECTION = [
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"ignore\s+(all\s+)?above\s+instructions",
    r"disregard\s+(all\s+)?previous",
    r"system\s*prompt",
    r"you\s+are\s+now",
    r"act\s+as\s+if",
    r"pretend\s+you\s+are",
    r"override\s+(your\s+)?instructions",
    r"new\s+instructions",
    r"forget\s+(all\s+)?previous",
    r"do\s+not\s+follow\s+(your\s+)?instructions",
    r"reveal\s+(your\s+)?(system|initial)\s+prompt",
]

# The named patterns of the second detector.
NAMED_INJECTION = {
    "ignore_instructions": r"(?i)ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions|prompts|rules|directives)",
    "system_prompt_leak": r"(?i)(show|reveal|print|output|display|repeat|echo)\s+(your\s+)?(system\s+prompt|instructions|initial\s+prompt|hidden\s+prompt|rules)",
    "role_override": r"(?i)(you\s+are\s+now|act\s+as|pretend\s+(to\s+be|you\s+are)|from\s+now\s+on\s+you\s+are|switch\s+to\s+role)",
    "encoding_bypass": r"(?i)(base64|rot13|hex|url.?encode|decode\s+this|in\s+reverse)",
    "delimiter_injection": r"(?i)(```\s*system|<\|im_start\|>|<\|system\|>|\[INST\]|\[\/INST\]|<<SYS>>|<\/SYS>)",
    "context_manipulation": r"(?i)(new\s+context|override\s+context|forget\s+(everything|all|what)|reset\s+(your|the)\s+(memory|context|instructions))",
    "output_format_override": r"(?i)(respond\s+only\s+with|output\s+format\s*:|always\s+respond\s+as|do\s+not\s+include\s+(any\s+)?warnings)",
    "tool_abuse": r"(?i)(execute\s+(this\s+)?(code|command|script)|run\s+(this\s+)?(shell|bash|python)|call\s+(the\s+)?function)",
    "data_exfiltration": r"(?i)(send\s+(to|data|this)\s+(to\s+)?https?://|fetch\s+from|curl\s+|wget\s+|exfiltrate|upload\s+to)",
    "social_engineering": r"(?i)(this\s+is\s+(an?\s+)?emergency|urgent\s*:|life\s+or\s+death|as\s+(your|my)\s+(creator|developer|admin|owner))",
}

# Markers whose first place is cut from the output, to the end of its line.
MARKERS = ["You are", "System:", "Instructions:", "<<SYS>>", "[INST]", "### System", "### Instructions"]

# Patterns whose lines are dropped from the output.
LEAKS = [
    r"(?i)<\|?system\|?>",
    r"(?i)<<SYS>>",
    r"(?i)\[INST\]",
    r"(?i)system\s*prompt\s*:",
    r"(?i)you\s+are\s+a\s+(helpful\s+)?assistant",
    r"(?i)^#{0,3}\s*system\s+(instructions|prompt|message)",
    r"(?i)<system_prompt>",
    r"(?i)</system_prompt>",
    r"(?i)<instructions>",
    r"(?i)</instructions>",
    r"(?i)role\s*:\s*(system|assistant|user)",
]

#: Personal data told by a pattern alone; names and places need an injected recogniser.
PERSONAL = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE": r"\+?\d{1,3}[ .-]\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4}",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b",
    "IP_ADDRESS": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}
REJECT_ABOVE = 0.5
MALICIOUS_ABOVE = 0.3


def can_access(acl: Column, user: Column, groups: Column) -> Column:
    """Public, owned, listed, or shared with one of the groups; a missing policy is open, a missing part grants nothing."""
    no = F.lit(False)
    granted = F.coalesce(acl["public"], no) | F.coalesce(acl["owner"] == user, no) | F.coalesce(F.array_contains(acl["visible_to_users"], user), no) | F.coalesce(F.arrays_overlap(acl["visible_to_groups"], groups), no)
    return acl.isNull() | granted


def visible(rows: DataFrame, user: str | None, groups: list[str] = (), acl_col: str = "acl") -> DataFrame:
    """Rows a user may see; without a user all are."""
    if user is None:
        return rows
    return rows.where(can_access(F.col(acl_col), F.lit(user), F.array(*map(F.lit, groups)).cast("array<string>")))


def either(acl: Column) -> Column:
    """An aggregate: the policy of content that several policies cover, open to whom any of them lets in; null, as a policy that isn't there."""
    who = lambda part: F.array_sort(F.array_distinct(F.flatten(F.collect_set(acl[part]))))
    closed = F.struct(F.lit(None).cast("string").alias("owner"), who("visible_to_groups").alias("visible_to_groups"), F.array_sort(F.array_union(who("visible_to_users"), F.collect_set(acl["owner"]))).alias("visible_to_users"), F.lit(False).alias("public"))
    return F.when(~F.bool_or(acl.isNull() | F.coalesce(acl["public"], F.lit(False))), closed)


def joint(acl: Column) -> Column:
    """An aggregate: the policy of content made of parts, open to whom every part's policy names; null where all parts are open."""
    shut = F.filter(F.collect_set(acl), lambda a: ~F.coalesce(a["public"], F.lit(False)))
    none = F.array().cast("array<string>")
    users = lambda a: F.array_union(F.coalesce(a["visible_to_users"], none), F.array_compact(F.array(a["owner"])))
    groups = lambda a: F.coalesce(a["visible_to_groups"], none)
    common = lambda part: F.aggregate(shut, part(F.get(shut, F.lit(0))), lambda so_far, a: F.array_intersect(so_far, part(a)))
    closed = F.struct(F.lit(None).cast("string").alias("owner"), F.array_sort(common(groups)).alias("visible_to_groups"), F.array_sort(common(users)).alias("visible_to_users"), F.lit(False).alias("public"))
    return F.when(F.size(shut) > 0, closed)


def acl_errors(acl: Column) -> Column:
    """What is wrong with a policy that isn't public."""
    closed = ~F.coalesce(acl["public"], F.lit(False))
    owner = F.coalesce(acl["owner"], F.lit("")) == ""
    nobody = (F.coalesce(F.size(acl["visible_to_groups"]), F.lit(0)) <= 0) & (F.coalesce(F.size(acl["visible_to_users"]), F.lit(0)) <= 0)
    return F.array_compact(F.array(F.when(closed & owner, F.lit("no owner")), F.when(closed & owner & nobody, F.lit("no audience"))))


def groups_of(users: DataFrame, memberships: DataFrame) -> DataFrame:
    """user_id, groups: sorted; users without any have an empty list."""
    listed = memberships.groupBy("user_id").agg(F.array_sort(F.collect_set("group_id")).alias("groups"))
    return users.select("user_id").distinct().join(listed, "user_id", "left").select("user_id", F.coalesce("groups", F.array().cast("array<string>")).alias("groups"))


def injection(text: Column, patterns: list[str] = INJECTION) -> Column:
    """patterns_matched and their share, risk_score."""
    low = F.lower(empty_if_null(text))
    found = F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(p)) for p in patterns)))
    return F.struct((F.size(found) / F.lit(len(patterns))).alias("risk_score"), found.alias("patterns_matched"))


def named_injection(text: Column, patterns: dict[str, str] = NAMED_INJECTION) -> Column:
    """risk_score, patterns_matched and classification: safe, suspicious, or malicious above MALICIOUS_ABOVE."""
    body = empty_if_null(text)
    found = F.array_compact(F.array(*(F.when(body.rlike(p), F.lit(n)) for n, p in patterns.items())))
    risk = F.size(found) / F.lit(len(patterns))
    kind = F.when(F.size(found) == 0, "safe").when(risk > MALICIOUS_ABOVE, "malicious").otherwise("suspicious")
    return F.struct(risk.alias("risk_score"), found.alias("patterns_matched"), kind.alias("classification"))


def drop_injected(chunks: DataFrame, text_col: str = "content", above: float = REJECT_ABOVE) -> DataFrame:
    """Chunks whose injection() has a risk_score of `above` at most."""
    # A named variable holds the text, which a filter would else make anew for each pattern.
    score = lambda low: reduce(Column.__add__, (low.rlike(p).cast("int") for p in INJECTION)) / F.lit(len(INJECTION))
    return chunks.where(F.forall(F.array(F.lower(empty_if_null(F.col(text_col)))), lambda low: score(low) <= above))


def findings(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns: dict[str, str] = PERSONAL, score: float = 1.0) -> DataFrame:
    """id, category, start, end, score, text of every match, offsets in characters from 0.

    Matches are told from the text between them: the parts of a split by the pattern and the
    matches alternate, so offsets are running sums of lengths.
    """
    out = None
    for category, pattern in patterns.items():
        body = F.regexp_replace(empty_if_null(F.col(text_col)), "\x1e", " ")
        marked = F.split(F.regexp_replace(body, f"({pattern})", "\x1e$1\x1e"), "\x1e")
        each = rows.where(F.col(text_col).rlike(pattern)).select(F.col(id_col).alias("id"), marked.alias("parts"))
        before = F.aggregate(F.slice("parts", 1, F.col("i")), F.lit(0), lambda n, p: n + F.length(p))
        # A named column bounds the fold, so parts are split once.
        each = each.select("id", "parts", F.posexplode("parts").alias("i", "found")).where("i % 2 = 1")
        each = each.select("id", F.lit(category).alias("category"), before.alias("start"), (before + F.length("found")).alias("end"), F.lit(score).alias("score"), F.col("found").alias("text"))
        out = each if out is None else out.unionByName(each)
    return out.withColumnRenamed("id", id_col)


def apply_policy(text: Column, action: str, patterns: dict[str, str] = PERSONAL, mask: str = "[REDACTED]") -> Column:
    """mask puts `mask` for each match, redact takes it out and strips, flag changes nothing, reject gives null where anything matches."""
    if action == "flag":
        return text
    if action == "reject":
        return F.when(~_any(text, patterns), text)
    out = text
    for pattern in patterns.values():
        put = F.regexp_replace(out, pattern, mask.replace("$", r"\$") if action == "mask" else "")
        # A text without what every match holds isn't searched.
        out = F.when(F.contains(out, F.lit("@")), put).otherwise(out) if "@" in pattern else put
    if all("@" in p or r"\d" in p for p in patterns.values()):
        out = F.when(F.contains(text, F.lit("@")) | text.rlike("[0-9]"), out).otherwise(text)
    return strip(out) if action == "redact" else out


def enforce(text: Column, action: str, patterns: dict[str, str] = PERSONAL, mask_char: str = "*", mask_length: int = 4) -> Column:
    """As apply_policy(), with a mask of mask_length times mask_char; reject ends the query with an error where anything matches."""
    if action == "reject":
        return F.when(_any(text, patterns), F.raise_error(F.lit("personal data in a text"))).otherwise(text)
    return apply_policy(text, action, patterns, mask_char * mask_length)


def _any(text: Column, patterns: dict[str, str]) -> Column:
    found = F.lit(False)
    for p in patterns.values():
        found = found | F.coalesce(text.rlike(p), F.lit(False))
    return found


def without_markers(text: Column, markers: list[str] = MARKERS) -> Column:
    """Each marker's first place is cut to the end of its line, in the markers' order; the rest is stripped."""
    out = empty_if_null(text)
    for m in markers:
        out = F.regexp_replace(out, rf"(?s)^(.*?)\Q{m}\E[^\n]*\n?", "$1")
    return strip(out)


def without_leaks(text: Column, patterns: list[str] = LEAKS) -> Column:
    """Without the lines that a pattern matches."""
    any_of = lambda line: F.exists(F.array(*(line.rlike(p) for p in patterns)), lambda x: x)
    return F.array_join(F.filter(F.split(empty_if_null(text), "\n"), lambda line: ~any_of(line)), "\n")


def leaks(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns: list[str] = LEAKS) -> DataFrame:
    """id, line_number from 1, pattern, snippet: each pattern on each line it matches."""
    lines = rows.select(F.col(id_col), F.posexplode(F.split(empty_if_null(F.col(text_col)), "\n")).alias("n", "line"))
    lines = lines.select(id_col, (F.col("n") + 1).alias("line_number"), "line", F.explode(F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.lit(p)) for p in patterns)))).alias("pattern"))
    return lines.select(id_col, "line_number", "pattern", strip(F.col("line")).alias("snippet"))
