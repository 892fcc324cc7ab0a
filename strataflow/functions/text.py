"""Canonical text, byte tokens and prompt helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonicalize(text: Column) -> Column:
    r"""Runs of space, \n, \t and \r become one space, and none is left at the ends; null stays null."""
    return F.btrim(F.regexp_replace(text, "[ \n\t\r]+", " "), F.lit(" "))


def token_count(text: Column) -> Column:
    """One token per UTF-8 byte."""
    return F.octet_length(text)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, where its uses stand inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def byte_tokens(text: Column) -> Column:
    """array<int> of the bytes of a text."""
    byte = lambda raw, i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int")
    each = lambda raw: F.transform(F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(1))), lambda i: byte(raw, i))
    return F.when(text == "", F.array().cast("array<int>")).when(text.isNotNull(), let(F.encode(text, "UTF-8"), each))


def general_number(value: Column) -> Column:
    """A number in six significant digits, without zeros at its end."""
    text = F.format_string("%.6g", value.cast("double"))
    bare = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when(value == 0, "0").otherwise(bare)


def joined_inputs(*parts: Column, kinds: list[str] | None = None, fixed: bool = False) -> Column:
    """What a cache keeps of several inputs: each canonical, joined by " | ", canonical again.

    kinds: what each input is; tokens and tensors are left empty, numbers written in six significant digits, or
    where `fixed` with six decimals.
    """
    written = []
    for part, kind in zip(parts, kinds or ["text"] * len(parts), strict=True):
        if kind == "number":
            part = F.format_string("%.6f", part.cast("double")) if fixed else general_number(part)
        written.append(F.lit("") if kind in ("tokens", "tensor", "shaped") else F.coalesce(canonicalize(part.cast("string")), F.lit("")))
    return canonicalize(F.concat_ws(" | ", *written))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two binaries, by steps that halve: each compares a slice of that length."""
    shorter = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def grow(known: Column, step: Column) -> Column:
        same = F.substring(a, known + 1, step) == F.substring(b, known + 1, step)
        return F.when((known <= shorter - step) & same, known + step).otherwise(known)

    return F.aggregate(steps, F.lit(0), grow)


def common_text_prefix(a: Column, b: Column) -> Column:
    """Length in bytes of the common prefix of two texts."""
    return common_prefix(F.encode(a, "UTF-8"), F.encode(b, "UTF-8"))


def common_array_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays of tokens."""
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(differs, True), F.lit(0)) - 1, F.size(a)).cast("int")


def format_value(value: Column) -> Column:
    return value.cast("string")


def format_prompt(*parts: Column) -> Column:
    """Parts joined by one space; a null part is left out."""
    return F.concat_ws(" ", *parts)


def critique_prompt(draft: Column) -> Column:
    return F.concat(F.lit("critique: "), draft)


def refine(draft: Column, critique: Column) -> Column:
    return F.concat(draft, F.lit(" | "), critique)


def classify(question: Column, labels: Column) -> Column:
    """The first label for questions with "math" in any case, else the last."""
    return F.when(F.lower(question).contains("math"), F.get(labels, F.lit(0))).otherwise(F.element_at(labels, -1))


def extract_expr(question: Column) -> Column:
    return question


def lm(model_id: str, prompt: Column) -> Column:
    """The echo model: its name, a colon, the prompt."""
    return F.concat(F.lit(f"{model_id}:"), prompt)


def retrieve(question: Column, k: int = 4) -> Column:
    """array of k document names for a question."""
    if k <= 0:
        return F.array().cast("array<string>")
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.concat(F.lit("doc:"), question, F.lit(":"), i.cast("string")))


@F.udtf(returnType="nth: int, doc: string")
class Retrieve:
    """retrieve() as a table function: a row a document, for LATERAL joins in SQL once it is registered."""

    def eval(self, question: str, k: int):
        for i in range(max(0, k or 0)):
            yield i, f"doc:{question}:{i}"


def answer_from_context(context: Column) -> Column:
    """What follows the last "is ", without white space around it and without one full stop at its end."""
    tail = F.btrim(F.substring_index(context, "is ", -1), F.lit(" \t\n\r\x0b\x0c"))
    return F.when(context.contains("is "), F.regexp_replace(tail, r"\.\z", "")).otherwise("unknown")


def reusable_prefix(prompt: Column) -> Column:
    """A prompt through its last " Question:"; all of it where there is none."""
    found = F.regexp_extract(prompt, r"(?s)^(.*) Question:", 0)
    return F.when(found == "", prompt).otherwise(found)


def capital_pairs(context: Column) -> Column:
    """array<struct<country, capital>> of all "The capital of X is Y" in a context."""
    pattern = F.lit("The capital of ([A-Za-z ]+) is ([A-Za-z ]+)")
    both = F.arrays_zip(F.regexp_extract_all(context, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(context, pattern, F.lit(2)).alias("b"))
    return F.transform(both, lambda p: F.struct(F.trim(p["a"]).alias("country"), F.trim(p["b"]).alias("capital")))


def exact_match(predicted: Column, answer: Column) -> Column:
    """1.0 where two texts are equal but for case and white space around them."""
    bare = lambda c: F.lower(F.btrim(c, F.lit(" \t\n\r\x0b\x0c")))
    return (bare(predicted) == bare(answer)).cast("double")


def json_escape(text: Column) -> Column:
    r"""A text for a JSON string: \ " and \n \r \t are escaped, nothing else."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def json_field(body: Column, name: str) -> Column:
    """The first quoted string after a quoted field name, escapes as they stand; null where there is none."""
    found = F.regexp_extract(body, f'"{name}"\\s*:[^"]*"((?:[^"\\\\]|\\\\.)*)"', 1)
    return F.when(body.rlike(f'"{name}"\\s*:[^"]*"((?:[^"\\\\]|\\\\.)*)"'), found)


def percentile(value: Column, p: float) -> Column:
    """Aggregate: the p-th percentile with linear interpolation, 0 for no values."""
    return F.coalesce(F.percentile(value, F.lit(p / 100.0)), F.lit(0.0))


def prefix_hash(model_id: Column, op_name: Column, max_tokens: Column, temp_milli: Column, prefix: Column) -> Column:
    return F.xxhash64(model_id, op_name, max_tokens, temp_milli, prefix)


def temp_milli(temperature: Column) -> Column:
    """The temperature in thousandths as single precision gives it; decode parameters compare by it."""
    return (temperature.cast("float") * F.lit(1000).cast("float")).cast("int")


def same_decode(a: Column, b: Column) -> Column:
    """Whether two structs of op_name, temperature and max_tokens share cache entries."""
    return (a["op_name"] == b["op_name"]) & (a["max_tokens"] == b["max_tokens"]) & (temp_milli(a["temperature"]) == temp_milli(b["temperature"]))
