"""Style sheets as rules, and the cascade as a join and a maximum."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Properties that descend to children.
INHERITED = ("color", "font-family", "font-size", "font-style", "font-weight", "line-height", "letter-spacing", "list-style-type", "text-align", "text-indent", "text-transform", "white-space", "direction", "visibility")
SIDES = ("top", "right", "bottom", "left")

RULE_SCHEMA = "doc_id long, rule_id int, selector string, property string, value string, important boolean"


def split_top_level(text: str, at: str) -> list[str]:
    """Splits at a character outside quotes and brackets."""
    out, now, quote, depth, skip = [], [], "", 0, False
    for c in text:
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif c == at and not depth:
            out.append("".join(now).strip())
            now = []
            continue
        now.append(c)
    out.append("".join(now).strip())
    return out


def _words(value: str) -> list[str]:
    return [x for x in split_top_level(re.sub(r"\s+", " ", value.strip()), " ") if x]


def unescaped(text: str) -> str:
    """CSS escapes as the characters they stand for: \\26 and its like with one space after, or any character after a backslash."""

    def one(m: re.Match) -> str:
        if m[1]:
            code = int(m[1], 16)
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        return "" if m[2] == "\n" else m[2]

    return re.sub(r"\\(?:([0-9A-Fa-f]{1,6})[ \t\n]?|(.|\n))", one, text)


def unquoted(text: str) -> str:
    """A string without its quotes, or a word as it stands, escapes resolved."""
    text = text.strip()
    if len(text) > 1 and text[0] in "\"'" and text[-1] == text[0]:
        text = text[1:-1]
    return unescaped(text)


def _four(values: list[str]) -> list[str]:
    return [values[0], values[1 % len(values)] if len(values) > 1 else values[0], values[2] if len(values) > 2 else values[0], values[3] if len(values) > 3 else (values[1] if len(values) > 1 else values[0])]


_STYLES = {"none", "hidden", "dotted", "dashed", "solid", "double", "groove", "ridge", "inset", "outset"}


def _edge(value: str) -> dict[str, str]:
    out = {"width": "medium", "style": "none", "color": "currentcolor"}
    for w in _words(value):
        low = w.lower()
        out["style" if low in _STYLES else "width" if re.match(r"[\d.]|thin$|medium$|thick$", low) else "color"] = w
    return out


def expand(name: str, value: str) -> dict[str, str]:
    """Longhands of a declaration."""
    if name in ("margin", "padding"):
        parts = _words(value)
        return {f"{name}-{s}": v for s, v in zip(SIDES, _four(parts))} if 1 <= len(parts) <= 4 else {}
    if m := re.fullmatch(r"(margin|padding)-(inline|block)", name):
        parts = _words(value)
        sides = ("left", "right") if m[2] == "inline" else ("top", "bottom")
        return {f"{m[1]}-{s}": parts[min(i, len(parts) - 1)] for i, s in enumerate(sides)} if parts else {}
    if m := re.fullmatch(r"(margin|padding)-(inline|block)-(start|end)", name):
        side = {("inline", "start"): "left", ("inline", "end"): "right", ("block", "start"): "top", ("block", "end"): "bottom"}[m[2], m[3]]
        return {f"{m[1]}-{side}": value}
    if name == "border":
        return {f"border-{s}-{k}": v for s in SIDES for k, v in _edge(value).items()}
    if m := re.fullmatch(r"border-(top|right|bottom|left)", name):
        return {f"{name}-{k}": v for k, v in _edge(value).items()}
    if m := re.fullmatch(r"border-(width|style|color)", name):
        parts = _words(value)
        return {f"border-{s}-{m[1]}": v for s, v in zip(SIDES, _four(parts))} if 1 <= len(parts) <= 4 else {}
    if name == "background":
        for w in _words(value):
            if re.match(r"#|rgb|hsl|[a-z]+$", w.lower()) and w.lower() not in ("none", "repeat", "no-repeat", "scroll", "fixed", "center", "top", "left", "right", "bottom"):
                return {"background-color": w}
        return {}
    if name == "text-decoration":
        words = _words(value.lower())
        lines = [w for w in words if w in ("none", "underline", "overline", "line-through")]
        waves = [w for w in words if w in ("solid", "double", "dotted", "dashed", "wavy")]
        return ({"text-decoration-line": " ".join(lines)} if lines else {}) | ({"text-decoration-style": waves[-1]} if waves else {})
    if name == "list-style":
        kinds = [w for w in _words(value.lower()) if w in ("none", "disc", "circle", "square", "decimal", "decimal-leading-zero", "lower-alpha", "upper-alpha", "lower-latin", "upper-latin", "lower-roman", "upper-roman", "lower-greek")]
        return {"list-style-type": kinds[-1]} if kinds else {}
    if name == "font":
        m = re.search(r"(?P<size>[\d.]+[a-z%]+|x{0,2}-?(?:small|large)|medium|smaller|larger)(?:\s*/\s*(?P<line>\S+))?\s+(?P<family>.+)$", value.strip(), re.I)
        if not m:
            return {}
        before = value[: m.start()].lower().split()
        style = next((w for w in before if w in ("italic", "oblique")), "normal")
        weight = next((w for w in before if w in ("bold", "bolder", "lighter") or w.isdigit()), "normal")
        return {"font-style": style, "font-weight": weight, "font-size": m["size"], "line-height": m["line"] or "normal", "font-family": m["family"]}
    return {name: value}


def declarations(block: str) -> dict[str, tuple[str, bool]]:
    """Longhand -> (value, important); the last of a block wins and moves to the end; custom properties are left out."""
    out: dict[str, tuple[str, bool]] = {}
    for one in split_top_level(block, ";"):
        name, colon, value = one.partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon or not value or name.startswith("--") or not re.fullmatch(r"[a-z-]+", name):
            continue
        important = bool(re.search(r"!\s*important\s*\Z", value, re.I))
        value = re.sub(r"\s*!\s*important\s*\Z", "", value, flags=re.I).strip()
        for k, v in expand(name, value).items():
            out.pop(k, None)
            out[k] = (v, important)
    return out


def style_rules(css: str) -> list[tuple[str, dict[str, tuple[str, bool]]]]:
    """(selector, declarations) in source order; @media for print, all or without a kind and @supports are entered."""
    css = re.sub(r"(?s)/\*.*?\*/", "", css)
    out, at = [], 0
    while (open_ := css.find("{", at)) >= 0:
        head, depth, i = css[at:open_].strip(), 1, open_ + 1
        while i < len(css) and depth:
            depth += {"{": 1, "}": -1}.get(css[i], 0)
            i += 1
        body = css[open_ + 1 : i - 1 if not depth else i]
        at = i
        if ";" in head:
            head = head.rpartition(";")[2].strip()
        if head.startswith("@"):
            kind, _, query = head[1:].partition(" ")
            media = kind.lower() == "media" and (re.search(r"\b(all|print)\b", query, re.I) or not re.search(r"[a-z]", re.sub(r"\([^)]*\)", "", query), re.I)) and "not " not in query.lower()
            if media or kind.lower() == "supports":
                out += style_rules(body)
            continue
        found = declarations(body)
        if found:
            out += [(s, found) for s in split_top_level(head, ",") if s and "::" not in s]
    return out


def stylesheet_rules(sheets: DataFrame, doc_id: str = "doc_id", css: str = "css") -> DataFrame:
    """One row per longhand of every rule (see RULE_SCHEMA); rule_id is the source order."""

    def run(batches):
        for b in batches:
            rows = []
            for key, value in zip(b.column(0).to_pylist(), b.column(1)):
                for i, (selector, found) in enumerate(style_rules(value.as_py() or "")):
                    rows += [{"doc_id": key, "rule_id": i, "selector": selector, "property": k, "value": v, "important": imp} for k, (v, imp) in found.items()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("rule_id", pa.int32()), ("selector", pa.string()), ("property", pa.string()), ("value", pa.string()), ("important", pa.bool_())]))

    return sheets.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(css).alias("css")).mapInArrow(run, RULE_SCHEMA)


def specificity(selector: Column) -> Column:
    """struct(ids, classes, types). :where() counts nothing; :is, :not and :has count all they hold."""
    s = F.regexp_replace(selector, r":where\([^()]*\)", "")
    s = F.regexp_replace(s, r":(?:is|not|has)\(", " ")
    s = F.regexp_replace(s, r"[\"'][^\"']*[\"']", "")
    attributes = F.regexp_count(s, F.lit(r"\[[^\]]*\]"))
    bare = F.regexp_replace(s, r"\[[^\]]*\]", "")
    ids = F.regexp_count(bare, F.lit(r"#[\w-]+"))
    classes = F.regexp_count(bare, F.lit(r"\.[\w-]+"))
    pseudo = F.regexp_count(bare, F.lit(r"(?<!:):[\w-]+"))
    types = F.regexp_count(F.regexp_replace(bare, r"[#.:][\w-]+(\([^)]*\))?", ""), F.lit(r"[A-Za-z][\w-]*"))
    return F.struct(ids.alias("ids"), (classes + attributes + pseudo).alias("classes"), types.alias("types"))


def simple_matches(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, node_id, rule columns): rules whose selector is one compound of tag, #id and .class, or `ancestor descendant` of two.

    The last compound meets nodes by equality on its tag (or any); an ancestor by equality on the path's nodes.
    """
    parts = F.split(F.trim("selector"), r"\s+")
    r = rules.where(~F.col("selector").rlike(r"[>+~:\[*(]")).withColumn("_last", F.element_at(parts, -1)).withColumn("_first", F.when(F.size(parts) == 2, F.get(parts, F.lit(0)))).where(F.size(parts) <= 2)

    def split(c: str) -> tuple[Column, Column, Column]:
        return F.lower(F.regexp_extract(c, r"\A([A-Za-z][\w-]*)", 1)), F.regexp_extract(c, r"#([\w-]+)", 1), F.regexp_extract_all(c, F.lit(r"\.([\w-]+)"), F.lit(1))

    def fits(tag: Column, id_: Column, classes: Column) -> Column:
        own = F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+")
        return ((tag == "") | (F.col("tag") == tag)) & ((id_ == "") | (F.col("attrs")["id"] == id_)) & (F.size(F.array_except(classes, own)) == 0)

    elements = nodes.where(~F.col("tag").startswith("#"))
    tag, id_, classes = split("_last")
    r = r.withColumn("_tag", tag).withColumn("_id", id_).withColumn("_classes", classes).withColumnRenamed("doc_id", "_doc")
    rest = fits(F.lit(""), F.col("_id"), F.col("_classes"))
    # Rules that name a tag meet nodes by document and tag; only those without one meet all of a document's.
    named = elements.join(r.where("_tag <> ''"), (F.col("doc_id") == F.col("_doc")) & (F.col("tag") == F.col("_tag")) & rest)
    hit = named.unionByName(elements.join(r.where("_tag = ''"), (F.col("doc_id") == F.col("_doc")) & rest))
    direct = hit.where("_first is null").select("doc_id", "node_id", "rule_id", "selector", "property", "value", "important")
    tag, id_, classes = split("_first")
    up = hit.where("_first is not null").select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), "rule_id", "selector", "property", "value", "important", F.explode("path").alias("_a"), tag.alias("_tag"), id_.alias("_id"), classes.alias("_classes"))
    below = elements.join(up, (F.col("doc_id") == F.col("_d")) & (F.col("node_id") == F.col("_a")) & fits(F.col("_tag"), F.col("_id"), F.col("_classes"))).select("doc_id", F.col("_n").alias("node_id"), "rule_id", "selector", "property", "value", "important").distinct()
    return direct.unionByName(below)


def element_matches(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """As simple_matches, for every selector: combinators, attributes and pseudo-classes. A document's tree is one kernel call."""
    from vellumite.kernels.dom import Node
    from vellumite.kernels.selectors import matcher

    trees = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "parent_id", "tag", F.map_entries("attrs").alias("attrs"), "text"))).alias("nodes"))
    sheets = rules.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_list(F.struct("rule_id", "selector", "property", "value", "important")).alias("rules"))
    both = trees.join(sheets, F.col("doc_id") == F.col("_d")).select("doc_id", "nodes", "rules")
    schema = pa.schema([("doc_id", pa.int64()), ("node_id", pa.int32()), ("rule_id", pa.int32()), ("selector", pa.string()), ("property", pa.string()), ("value", pa.string()), ("important", pa.bool_())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                root, made = Node("#document"), {}
                for x in row["nodes"]:
                    node = Node(x["tag"], {a["key"]: a["value"] for a in x["attrs"]}, x["text"] or "")
                    made[x["node_id"]] = node
                    made.get(x["parent_id"], root).add(node)
                tests = {s: matcher(s) for s in {x["selector"] for x in row["rules"]}}
                out = [{"doc_id": row["doc_id"], "node_id": i, **x} for x in row["rules"] if tests[x["selector"]] for i, n in made.items() if n.tag[0] != "#" and tests[x["selector"]](n)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return both.mapInArrow(run, "doc_id long, node_id int, rule_id int, selector string, property string, value string, important boolean")


def inline_styles(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, property, value, important) of the style attributes."""
    schema = pa.schema([("doc_id", pa.int64()), ("node_id", pa.int32()), ("property", pa.string()), ("value", pa.string()), ("important", pa.bool_())])

    def run(batches):
        for b in batches:
            out = [{"doc_id": d, "node_id": n, "property": k, "value": v, "important": i} for d, n, css in zip(*(c.to_pylist() for c in b.columns)) for k, (v, i) in declarations(css).items()]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    styled = nodes.where("attrs['style'] is not null").select("doc_id", "node_id", F.col("attrs")["style"].alias("css"))
    return styled.mapInArrow(run, "doc_id long, node_id int, property string, value string, important boolean")


def cascade(matches: DataFrame, origin: Column | None = None, inline: DataFrame | None = None) -> DataFrame:
    """(doc_id, node_id, property, value): of the matching declarations the important, then the later origin, the more specific, the later.

    `inline` has the declarations of style attributes: they win over sheets of the same importance.
    """
    spec = specificity(F.col("selector"))
    order = F.struct("important", (origin if origin is not None else F.lit(2)).alias("origin"), spec.alias("spec"), F.col("rule_id"))
    every = matches.select("doc_id", "node_id", "property", "value", order.alias("_order"))
    if inline is not None:
        none = F.struct(*[F.lit(0).alias(n) for n in ("ids", "classes", "types")])
        top = F.struct("important", F.lit(9).alias("origin"), none.alias("spec"), F.lit(0).alias("rule_id"))
        every = every.unionByName(inline.select("doc_id", "node_id", "property", "value", top.alias("_order")))
    return every.groupBy("doc_id", "node_id", "property").agg(F.max_by("value", "_order").alias("value"))


def inherited(nodes: DataFrame, winners: DataFrame, properties: tuple[str, ...] = INHERITED) -> DataFrame:
    """(doc_id, node_id, property, value): the value of the nearest ancestor or self that declares it."""
    won = winners.where(F.col("property").isin(*properties)).select(F.col("doc_id").alias("_d"), F.col("node_id").alias("_n"), "property", "value")
    lines = nodes.select("doc_id", "node_id", F.posexplode(F.concat("path", F.array("node_id"))).alias("_depth", "_a"))
    met = lines.join(won, (F.col("doc_id") == F.col("_d")) & (F.col("_a") == F.col("_n")))
    return met.groupBy("doc_id", "node_id", "property").agg(F.max_by("value", "_depth").alias("value"))
