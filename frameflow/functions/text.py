"""Text codecs and parsers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the first anchors; further ones are anchor_4, anchor_5 and so on.
ANCHORS = ("start", "one_third", "two_third", "end")
#: Patterns of a point in a model's answer, on lower-cased text, in order of priority.
POINT_PATTERNS = (
    r'<point\s+x="([0-9]+(?:\.[0-9]+)?)"\s+y="([0-9]+(?:\.[0-9]+)?)"',
    r"gripper\s+coordinates?\s*[:\s]*\(?\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*\)?",
    r"coordinates?\s*[:\s]*\(?\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*\)?",
    r"\(?\s*(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)\s*\)?",
    r"x\s*[:\s]*(\d+(?:\.\d+)?).*?y\s*[:\s]*(\d+(?:\.\d+)?)",
    r"(\d+(?:\.\d+)?)\s*,\s*(\d+(?:\.\d+)?)",
)
#: What asks a model for a trace, by style, and for latent tokens.
TRACE_PROMPTS = {
    "plain": "Predict the gripper trace as {n} anchor points (start, intermediate, end) in [[x,y]] format with coords 0-1000.",
    "qwen_point_2d": 'Predict the gripper trace as a JSON list of {n} anchor points, each formatted as {{"point_2d": [x, y], "label": "anchor_N"}}, with coords 0-1000.',
    "cot_bbox": "To identify the gripper trace, locate {n} anchor points in [[x,y]] format with coords 0-1000.",
}
LATENT_PROMPT = "Predict {n} latent action tokens"
#: Sizes that are written with these units, in GB.
GB_UNITS = {"": 1 / 1024**3, "B": 1 / 1024**3, "kB": 1 / 1024**2, "M": 1 / 1024, "MB": 1 / 1024, "G": 1.0, "GB": 1.0, "T": 1024.0, "TB": 1024.0}


def thousandths(v: Column) -> Column:
    """0..1, clipped, in whole thousandths, halves to even."""
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 1000).cast("int")


def trace_to_text(points: Column, style: str = "plain") -> Column:
    """An array of (x, y) structs in 0..1 as text: `[[x, y], ...]` (styles plain and cot_bbox), or labelled 2-D points."""
    pair = lambda p: F.concat(F.lit("["), thousandths(p["x"]).cast("string"), F.lit(", "), thousandths(p["y"]).cast("string"), F.lit("]"))
    if style in ("plain", "cot_bbox"):
        return F.concat(F.lit("["), F.array_join(F.transform(points, pair), ", "), F.lit("]"))
    if style == "qwen_point_2d":
        label = lambda i: F.coalesce(F.get(F.array(*map(F.lit, ANCHORS)), i), F.concat(F.lit("anchor_"), i.cast("string")))
        one = lambda p, i: F.concat(F.lit('{"point_2d": '), pair(p), F.lit(', "label": "'), label(i), F.lit('"}'))
        return F.concat(F.lit("["), F.array_join(F.transform(points, one), ", "), F.lit("]"))
    raise ValueError(f"unknown style {style!r}")


def text_to_trace(text: Column, anchors: int = 4, style: str = "plain") -> Column:
    """`anchors` points in 0..1, clipped, from a model's answer.

    A well-formed list of the style is read as such, numbers cut to integers. From anything else all pairs of
    integers in brackets are taken. Surplus points are dropped, too few repeat the last, none are zeros.
    """
    if style in ("plain", "cot_bbox"):
        shape, schema = r"^\s*\[\s*(?:\[[^\[\]]*\]\s*,?\s*)*\]\s*$", "array<array<double>>"
        read = F.from_json(text, schema)
    elif style == "qwen_point_2d":
        shape, schema = r"^\s*\[\s*(?:\{[^{}]*\}\s*,?\s*)*\]\s*$", "array<struct<point_2d:array<double>>>"
        read = F.filter(F.transform(F.from_json(text, schema), lambda p: p["point_2d"]), lambda p: p.isNotNull())
    else:
        raise ValueError(f"unknown style {style!r}")
    whole = text.rlike(shape) & (F.size(read) > 0) & F.forall(read, lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("long") / 1000.0))
    point = lambda x, y: F.struct(unit(x).alias("x"), unit(y).alias("y"))
    found, other = (F.regexp_extract_all(text, F.lit(r"\[\s*(-?\d+)\s*,\s*(-?\d+)\s*\]"), F.lit(k)) for k in (1, 2))
    listed = F.transform(read, lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    pairs = F.slice(F.when(F.coalesce(whole, F.lit(False)), listed).otherwise(F.zip_with(found, other, point)), 1, anchors)
    last = F.when(F.size(pairs) > 0, F.element_at(pairs, -1)).otherwise(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    return F.concat(pairs, F.array_repeat(last, F.lit(anchors) - F.size(pairs)))


def parse_point(text: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """(x, y) by the first pattern that gives a point in range; null if none does."""
    low_text = F.lower(text)
    tries = []
    for p in POINT_PATTERNS:
        x, y = (F.nullif(F.regexp_extract(low_text, p, k), F.lit("")).cast("double") for k in (1, 2))
        tries.append(F.when(x.between(low, high) & y.between(low, high), F.struct(x.alias("x"), y.alias("y"))))
    return F.coalesce(*tries)


def latent_tokens(codes: Column) -> Column:
    """`<LAM_i>` for each code."""
    return F.array_join(F.transform(codes, lambda c: F.concat(F.lit("<LAM_"), c.cast("string"), F.lit(">"))), "")


def latent_codes(text: Column, most: int | None = None) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"<LAM_(\d+)>"), 1), lambda s: s.cast("long"))
    return F.slice(found, 1, most) if most is not None else found


def _modes(mode: str, order: str) -> tuple[str, ...]:
    """What a mode is made of, in order; `latent_trace`, as mode or order, puts latent tokens first."""
    mode, order = mode.lower(), order.lower()
    if mode in ("trace_only", "latent_only"):
        return (mode.removesuffix("_only"),)
    if mode in ("trace_latent", "latent_trace"):
        return ("latent", "trace") if "latent_trace" in (mode, order) else ("trace", "latent")
    raise ValueError(f"unknown mode {mode!r}")


def semantic_target(mode: str, trace: Column | None, latent: Column | None, order: str = "trace_latent") -> Column:
    """The text that a model is to produce: trace text, latent tokens, or both end to end."""
    given = {"trace": trace, "latent": latent}
    parts = [given[k] for k in _modes(mode, order)]
    if any(p is None for p in parts):
        raise ValueError(f"mode {mode!r} needs {' and '.join(_modes(mode, order))}")
    return F.concat(*parts)


def trace_prompt(style: str, anchors: int = 4) -> str:
    """What asks for a trace in a style."""
    if style.lower() not in TRACE_PROMPTS:
        raise ValueError(f"unknown style {style!r}")
    return TRACE_PROMPTS[style.lower()].format(n=anchors)


def semantic_prompt(mode: str, style: str, anchors: int = 4, latent: int = 4, order: str = "trace_latent") -> str:
    """What asks for the text of semantic_target()."""
    parts = _modes(mode, order)
    ask = LATENT_PROMPT.format(n=latent)
    if parts == ("trace",):
        return trace_prompt(style, anchors)
    if parts == ("latent",):
        return ask + "."
    if parts[0] == "latent":
        return f"{ask}, then {trace_prompt(style, anchors)}"
    return f"{trace_prompt(style, anchors)} Then {ask[0].lower()}{ask[1:]}."


def prompt(task: Column, suffix: str) -> Column:
    """An instruction with what is asked."""
    return F.concat(task, F.lit(". " + suffix))


def json_object(text: Column) -> Column:
    """The widest stretch from { to } in a noisy text; empty if there is none."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def suite(name: Column) -> Column:
    """Which of the four task suites a dataset name has; empty for others."""
    return F.regexp_extract(F.lower(name), r"libero_(spatial|object|goal|10)(?:_|$)", 1)


def rate(name: Column) -> Column:
    """NN/100 from a name ending in %NN; 1 without."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"%(\d+)$", 1), F.lit("")).cast("double") / 100.0, F.lit(1.0))


def gigabytes(size: Column) -> Column:
    """A size such as `1.5MB` or `3G/10G` (what is before the slash counts) in GB of 1024-based units.

    0 if it doesn't begin with a number; null if that is no number or the unit unknown.
    """
    first = F.trim(F.element_at(F.split(size, "/"), 1))
    shape = r"^([0-9.]+)([kMGT]?B?)"
    unit = F.regexp_extract(first, shape, 2)
    factor = F.element_at(F.create_map(*(F.lit(x) for pair in GB_UNITS.items() for x in pair)), unit)
    return F.when(first.rlike(shape), F.regexp_extract(first, shape, 1).try_cast("double") * factor).otherwise(F.when(size.isNotNull(), F.lit(0.0)))


def slug(tag: Column) -> Column:
    """A tag in lower case with hyphens for underscores, slashes and blanks, one for each."""
    return F.translate(F.lower(F.regexp_replace(tag, r"^\s+|\s+$", "")), "_/ ", "---")


def column_name(path: Column) -> Column:
    """The dotted column name of a nested feature path."""
    return (
        F.when(path.rlike(r"^steps/observation/.*image"), F.concat(F.lit("observation.images."), F.replace(F.regexp_replace(path, r"^steps/observation/", ""), F.lit("/"), F.lit("."))))
        .when(path.startswith("steps/observation/"), F.concat(F.lit("observation."), F.replace(F.regexp_replace(path, r"^steps/observation/", ""), F.lit("/"), F.lit("."))))
        .when(path.startswith("steps/"), F.replace(F.regexp_replace(path, r"^steps/", ""), F.lit("/"), F.lit(".")))
        .otherwise(F.replace(path, F.lit("/"), F.lit(".")))
    )


def mode(name: Column) -> Column:
    """Action modes under their names: raw and absolute are abs, and so is what isn't known."""
    low = F.lower(name)
    return F.when(low.isin("delta", "rel", "abs"), low).otherwise("abs")


def role(name: Column) -> Column:
    return F.when(name == "human", "user").when(name == "gpt", "assistant").otherwise(name)


def config_key(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)


def first_key(text: Column, *keys: str) -> Column:
    """The value of the first of these keys that a JSON object has."""
    return F.coalesce(*(F.get_json_object(text, f"$.{k}") for k in keys))


def prefixed(key: str, kind: str) -> str:
    """A feature's key with its kind (action, state) in front, once."""
    return key if key.startswith(f"{kind}.") else f"{kind}.{key}"


def first_text(fallback: Column, *texts: Column) -> Column:
    """The first of the texts that is not empty (blanks count as text), else the fallback."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts), fallback)
