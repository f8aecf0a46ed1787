"""Classification of free text and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def is_json_object(c: Column) -> Column:
    """Whether the text is one JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def reply_shape(c: Column) -> Column:
    """``empty``, ``fenced``, ``bare_object`` or ``other``."""
    text = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(text == "", "empty").when(c.contains("```"), "fenced").when(text.startswith("{"), "bare_object").otherwise("other")


def defenced(c: Column) -> Column:
    """The first fenced body, or the text itself."""
    return F.regexp_replace(F.when(c.rlike(FENCE), F.regexp_extract(c, FENCE, 1)).otherwise(c), r"^\s+|\s+$", "")


# Fixed patterns: fences with info string (an open fence runs to the end), and what chart code looks like in them.
OPEN_FENCE = r"(?ms)^[ ]{0,3}```([^\r\n`]*)\r?\n(.*?)(?:^[ ]{0,3}```[ \t]*(?:\r?\n|\z)|\z)"
CODE = {
    "matplotlib": r"(?i)\b(?:matplotlib|pyplot)\b|\bplt\s*\.\s*(?:bar|barh|hist|imshow|pie|plot|scatter|stackplot|stem)\b",
    "plotly": r"(?i)\bplotly\b|\b(?:px|go)\s*\.\s*(?:area|bar|box|figure|histogram|line|pie|scatter)\b",
    "altair": r"(?i)\baltair\b|\balt\s*\.\s*chart\b",
    "seaborn": r"(?i)\bseaborn\b|\bsns\s*\.\s*(?:barplot|boxplot|catplot|displot|histplot|lineplot|pairplot|scatterplot|violinplot)\b",
}
SVG = r"(?i)<\s*svg(?:\s|>)"
DATA_IMAGE = r"(?i)\bdata:image/[a-z0-9.+-]+(?:;[^\s,]*)?,"
CHART_KEYS = ("data", "dataset", "datasets", "facet", "hconcat", "layer", "repeat", "vconcat")


def fences(c: Column) -> Column:
    """``array<struct<info, body>>`` of a text's fenced blocks."""
    pattern = F.lit(OPEN_FENCE)
    infos, bodies = F.regexp_extract_all(c, pattern, F.lit(1)), F.regexp_extract_all(c, pattern, F.lit(2))
    return F.transform(
        F.arrays_zip(infos.alias("info"), bodies.alias("body")),
        lambda x: F.struct(F.lower(F.trim(x["info"])).alias("info"), x["body"].alias("body")),
    )


def _is_chart_json(c: Column) -> Column:
    """A JSON object with the library's schema, or with a mark, an encoding that is an object and some source of data; a key counts
    where it is there, whatever its value."""
    v = F.try_parse_json(c)
    of = lambda path: F.try_variant_get(v, path, "variant")
    kind = lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))
    ours = F.lower(F.try_variant_get(v, "$['$schema']", "string")).contains("vega.github.io/schema/vega-lite/")
    data = F.lit(False)
    for k in CHART_KEYS:
        data |= of(f"$.{k}").isNotNull()
    shaped = of("$.mark").isNotNull() & kind(of("$.encoding")) & data
    return kind(v) & (F.coalesce(ours, F.lit(False)) | shaped)


def chart_signals(c: Column) -> Column:
    """Names of the direct-chart forms that a text holds, in fixed order."""
    blocks = fences(c)
    joined = F.transform(blocks, lambda x: F.concat_ws("\n", x["info"], x["body"]))
    holds = lambda pattern: F.exists(joined, lambda x: x.rlike(pattern))
    code = [F.when(holds(p), name) for name, p in CODE.items()]
    first = lambda x: F.split(x["info"], r"\s+")[0]
    labelled = F.filter(blocks, lambda x: (x["info"] == "") | first(x).isin("json", "vega", "vega-lite", "vegalite"))
    candidates = F.concat(F.array(F.trim(c)), F.transform(labelled, lambda x: F.trim(x["body"])))
    return F.array_compact(
        F.array(
            *code,
            F.when(F.exists(blocks, lambda x: first(x) == "mermaid"), "mermaid"),
            F.when(c.rlike(SVG), "svg"),
            F.when(F.exists(candidates, _is_chart_json), "vega-lite"),
            F.when(c.rlike(DATA_IMAGE), "data-image"),
        )
    )


def safe_bytes(c: Column) -> Column:
    """Bytes as a JSON string token where they are UTF-8, with every control sign escaped so that no terminal acts on it; as
    base64 otherwise."""
    token = F.to_json(F.array(c.cast("string")))
    text = token.substr(F.lit(2), F.length(token) - 2)
    text = F.replace(text, F.lit("\u007f"), F.lit("\\u007f"))
    for sign in range(0x80, 0xA0):
        text = F.replace(text, F.lit(chr(sign)), F.lit(f"\\u{sign:04x}"))
    return F.when(F.is_valid_utf8(c), text).otherwise(F.base64(c))
