"""Deterministic token generators: stand-ins for language models, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataflow.functions.text import byte_tokens, canonicalize, general_number, let, reusable_prefix


@dataclass(frozen=True)
class Rule:
    """Output token i is (prompt token i mod n + i + salt) mod modulus; text tokens may be salted beforehand."""

    salt: int
    modulus: int
    salted_text: bool = False
    canonical: bool = False


# Salts and moduli of the simulated backends.
RULES = {
    "fake": Rule(97, 10009),
    "openai": Rule(17, 10007, salted_text=True),
    "anthropic": Rule(29, 10009, salted_text=True),
    "vllm": Rule(43, 10037, canonical=True),
}


def prompt_tokens(rule: Rule, prompt: Column) -> Column:
    """The tokens a rule reads from a text: an empty one counts as one space, but for a canonical one."""
    text = canonicalize(prompt) if rule.canonical else F.when(prompt == "", F.lit(" ")).otherwise(prompt)
    tokens = byte_tokens(text)
    return F.transform(tokens, lambda x: (x + rule.salt) % rule.modulus) if rule.salted_text else tokens


def generate(rule: Rule, tokens: Column, max_tokens: int) -> Column:
    """array<int> of max_tokens output tokens, none for a negative count; no prompt tokens count as zeros."""
    if max_tokens <= 0:
        return F.array().cast("array<int>")

    def out(known: Column) -> Column:
        base = lambda i: F.coalesce(F.get(known, i % F.greatest(F.size(known), F.lit(1))), F.lit(0))
        each = F.transform(F.sequence(F.lit(0), F.lit(max_tokens - 1)), lambda i: (base(i) + i + rule.salt) % rule.modulus)
        return F.when(known.isNotNull(), each)

    return let(tokens, out)


def _bytes_as_letters(value: Column, kind: str) -> Column:
    """A text, or tokens as bytes, in which each letter stands for one byte."""
    if kind == "tokens":
        return F.array_join(F.transform(value, lambda x: F.chr(x.bitwiseAND(255))), "")
    if kind in ("tensor", "shaped"):
        return F.lit("")
    text = general_number(value) if kind == "number" else value.cast("string")
    return F.decode(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), "ISO-8859-1")


def read_inputs(name: str, inputs: list[Column], kinds: list[str]) -> Column:
    """array<int> of the prompt tokens that a rule reads from an operator's inputs.

    All but vllm read the first input alone: tokens as they are, a text byte by byte and not canonical, a space
    for anything else. vllm reads all inputs, a line each, canonical.
    """
    rule = RULES[name]
    if rule.canonical:
        lines = canonicalize(F.concat_ws("\n", *[_bytes_as_letters(c, k) for c, k in zip(inputs, kinds, strict=True)]))
        one = let(lines, lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t)), lambda i: F.ascii(F.substring(t, i, F.lit(1)))))
        return F.when(lines == "", F.array().cast("array<int>")).otherwise(one) if inputs else F.array().cast("array<int>")
    if inputs and kinds[0] == "tokens":
        return inputs[0].cast("array<int>")
    return prompt_tokens(rule, F.coalesce(inputs[0], F.lit("")) if inputs and kinds[0] == "text" else F.lit(""))


def run(name: str, prompt: Column, max_tokens: int, remaining: Column | None = None, has_state: Column | None = None) -> Column:
    """struct<output, compute_steps, tokens_sent, tokens_saved, reused_prefix_len, used_cached_state> of one call."""
    rule = RULES[name]
    tokens = prompt_tokens(rule, prompt)
    size = F.greatest(F.octet_length(prompt), F.lit(1))
    left = F.greatest(F.coalesce(remaining, size), F.lit(0)) if remaining is not None else size
    state = F.coalesce(has_state, F.lit(False)) if has_state is not None else F.lit(False)
    if name == "vllm":
        whole, shared = F.octet_length(canonicalize(prompt)), F.octet_length(reusable_prefix(canonicalize(prompt)))
        sent = F.when(state, F.when(left > 0, F.greatest(whole - shared, F.lit(0))).otherwise(0)).otherwise(whole)
        reused = F.when(state, shared).otherwise(0)
        return F.struct(generate(rule, tokens, max_tokens).alias("output"), sent.alias("compute_steps"), sent.alias("tokens_sent"), reused.alias("tokens_saved"), reused.alias("reused_prefix_len"), state.alias("used_cached_state"))
    reused = F.when(state, F.greatest(size - left, F.lit(0))).otherwise(0)
    counted = name == "fake"  # the others leave their counters at zero
    return F.struct(
        generate(rule, tokens, max_tokens).alias("output"), (left + max(0, max_tokens)).alias("compute_steps"),
        (left if counted else F.lit(0)).alias("tokens_sent"), (reused if counted else F.lit(0)).alias("tokens_saved"),
        reused.alias("reused_prefix_len"), state.alias("used_cached_state"),
    )
