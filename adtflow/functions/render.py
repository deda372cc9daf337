"""Measuring, node boxes, escaping and markdown fences."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from adtflow.plans.lang import Decl, Field, Signature
from adtflow.plans.model import Edge, Model, build
from adtflow.plans.text import variant_text

# Code point ranges that are a full em wide in a monospace face, all others being 0.6 em.
WIDE_RANGES = (
    (0x1100, 0x115F), (0x2E80, 0x303E), (0x3041, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xAC00, 0xD7A3),
    (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFF60), (0xFFE0, 0xFFE6), (0x1F300, 0x1F9FF), (0x20000, 0x2FFFD), (0x30000, 0x3FFFD),
)
NARROW_TENTHS, WIDE_TENTHS, HEIGHT_TENTHS = 6, 10, 12
BADGE = 16

WIDE_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in WIDE_RANGES) + "]"


def width_tenths(text: Column) -> Column:
    """The text's width in tenths of an em."""
    n = F.length(text)
    wide = n - F.length(F.regexp_replace(text, WIDE_CLASS, ""))
    return (n * NARROW_TENTHS + wide * (WIDE_TENTHS - NARROW_TENTHS)).cast("long")


def measure(text: str, font: float) -> tuple[float, float]:
    wide = 0 if text.isascii() else sum(any(a <= ord(c) <= b for a, b in WIDE_RANGES) for c in text)
    tenths = len(text) * NARROW_TENTHS + wide * (WIDE_TENTHS - NARROW_TENTHS)
    return tenths * font / 10, font * HEIGHT_TENTHS / 10


def measure_block(lines: list[str], font: float) -> tuple[float, float]:
    return max((measure(x, font)[0] for x in lines), default=0.0), len(lines) * font * HEIGHT_TENTHS / 10


def escape_text(s: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(mark), F.lit(name))
    return s


def escape_attribute(s: Column) -> Column:
    return F.replace(F.replace(escape_text(s), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))


def _escaped(s: str, attribute: bool = False) -> str:
    s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return s.replace('"', "&quot;").replace("'", "&#39;") if attribute else s


# -- node boxes --------------------------------------------------------------------------------------------


def header(d: Decl) -> str:
    tag = {"record": "", "union": "union ", "alias": "alias ", "function": "function "}[d.kind]
    return tag + d.name + (f"<{', '.join(d.generics)}>" if d.generics else "")


def _row(f: Field) -> str:
    return f"{f.name}: {f.type}"


def _signature(s: Signature) -> str:
    return f"{'async ' * s.is_async}({', '.join(map(_row, s.params))}) → {s.returns}"


def rows_of(d: Decl) -> list[str]:
    if d.kind == "record":
        return [_row(f) for f in d.fields]
    if d.kind == "union":
        return [variant_text(v) for v in d.variants]
    return [f"= {d.target}"] if d.kind == "alias" else [_signature(s) for s in d.signatures]


def boxes(model: Model, font: float = 14, pad_x: float = 12, pad_y: float = 8, header_pad: float = 6) -> list[dict]:
    """One box a declaration: header, rows with their y, and whole-pixel size; unions have room for a badge."""
    row_height, head_height = font * 1.4 + pad_y * 0.5, font * 1.4 + header_pad * 2
    out = []
    for d in model.decls:
        texts, y = rows_of(d), head_height + (BADGE if d.kind == "union" else 0)
        widest = max(measure(t, font)[0] for t in [header(d), *texts])
        rows = []
        for t in texts:
            rows.append({"text": t, "y": y, "height": row_height})
            y += row_height
        out.append({"id": d.name, "header": header(d), "kind": d.kind, "rows": rows, "width": math.ceil(widest + 2 * pad_x), "height": math.ceil(y)})
    return out


def place(nodes: list[dict], edges: list[Edge], gap: float = 60) -> list[dict]:
    """Boxes in columns by distance along edges, each column from the top: a plain layered layout."""
    level = {n["id"]: 0 for n in nodes}
    for _ in nodes:
        for e in edges:
            if e.source != e.target and e.source in level and e.target in level and level[e.target] < level[e.source] + 1 <= len(nodes) - 1:
                level[e.target] = level[e.source] + 1
    out, x = [], 0.0
    for k in sorted(set(level.values())):
        column, y = [n for n in nodes if level[n["id"]] == k], 0.0
        for n in column:
            out.append(n | {"x": x, "y": y})
            y += n["height"] + gap
        x += max(n["width"] for n in column) + gap
    return out


THEMES = {
    "light": {"paper": "#ffffff", "box": "#f8f9fb", "line": "#5b6472", "text": "#1c2330"},
    "dark": {"paper": "#14181f", "box": "#1f2631", "line": "#8c97a8", "text": "#e8ecf2"},
}


def midpoint(points: list[tuple[float, float]]) -> tuple[float, float]:
    """The point halfway along a polyline."""
    if not points:
        return 0.0, 0.0
    legs = [math.dist(a, b) for a, b in zip(points, points[1:], strict=False)]
    half = sum(legs) / 2
    for (a, b), leg in zip(zip(points, points[1:], strict=False), legs, strict=True):
        if leg and half <= leg:
            return a[0] + (b[0] - a[0]) * half / leg, a[1] + (b[1] - a[1]) * half / leg
        half -= leg
    return points[-1]


def svg(model: Model, theme: str = "light", font: float = 14, hooks: dict | None = None) -> tuple[str, list[str]]:
    """The model as SVG text. ``hooks`` maps a phase (defs, background, edge, node, row, post) to a function of
    (context, default text) giving other text; one that fails is reported and its default used."""
    colour, problems = THEMES[theme], []

    def phase(name: str, context: dict, text: str) -> str:
        hook = (hooks or {}).get(name)
        if hook is None:
            return text
        try:
            return hook(context, text)
        except Exception as e:  # noqa: BLE001 - a hook is foreign code
            problems.append(f"{name}: {e}")
            return text

    nodes = place(boxes(model, font), model.edges)
    at = {n["id"]: n for n in nodes}
    width, height = max((n["x"] + n["width"] for n in nodes), default=0), max((n["y"] + n["height"] for n in nodes), default=0)
    parts = [phase("defs", {}, "<defs/>"), phase("background", {"width": width, "height": height}, f'<rect width="{width:g}" height="{height:g}" fill="{colour["paper"]}"/>')]
    for e in model.edges:
        a, b = at[e.source], at[e.target]
        row_y = a["rows"][e.row]["y"] + a["rows"][e.row]["height"] / 2 if 0 <= e.row < len(a["rows"]) else a["height"] / 2
        points = [(a["x"] + a["width"], a["y"] + row_y), (b["x"], b["y"] + b["height"] / 2)]
        mx, my = midpoint(points)
        dash = ' stroke-dasharray="3 3"' if e.kind == "genericArg" else ""
        text = f'<polyline points="{" ".join(f"{x:g},{y:g}" for x, y in points)}" fill="none" stroke="{colour["line"]}"{dash}/><text x="{mx:g}" y="{my:g}" fill="{colour["line"]}">{_escaped(e.label)}</text>'
        parts.append(phase("edge", {"edge": e, "points": points}, text))
    for n in nodes:
        lines = [f'<rect width="{n["width"]}" height="{n["height"]}" fill="{colour["box"]}" stroke="{colour["line"]}"/>', f'<text x="12" y="{font * 1.2 + 6:g}" font-weight="bold">{_escaped(n["header"])}</text>']
        if n["kind"] == "union":
            lines.append(f'<text x="12" y="{font * 2.4 + 6:g}" font-size="{font * 0.7:g}">one of</text>')
        for i, r in enumerate(n["rows"]):
            divider = f'<line x1="0" x2="{n["width"]}" y1="{r["y"]:g}" y2="{r["y"]:g}" stroke="{colour["line"]}" stroke-dasharray="2 2"/>' if n["kind"] == "union" and i else ""
            lines.append(phase("row", {"node": n["id"], "row": i}, f'{divider}<text x="12" y="{r["y"] + font:g}">{_escaped(r["text"])}</text>'))
        parts.append(phase("node", {"node": n}, f'<g transform="translate({n["x"]:g} {n["y"]:g})" fill="{colour["text"]}" data-name="{_escaped(n["id"], True)}">{"".join(lines)}</g>'))
    whole = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {height:g}" font-family="monospace" font-size="{font:g}">{"".join(parts)}</svg>'
    return phase("post", {"model": model}, whole), problems


def render(source: str, **options) -> tuple[str | None, list]:
    """Source text to SVG: (text, diagnostics); no text where there are errors."""
    model = build(source)
    if not model.ok:
        return None, model.diagnostics
    return svg(model, **options)[0], model.diagnostics


# -- markdown ----------------------------------------------------------------------------------------------

FENCE = r"(?im)^(`{3,})adtflow[^\n`]*\n([\s\S]*?)^\1[ \t]*$"


def fences(markdown: str) -> list[tuple[int, int, str]]:
    """(start, end, source) of each fenced schema; a fence closes at as many backticks as opened it."""
    return [(m.start(), m.end(), m.group(2)) for m in re.finditer(FENCE, markdown)]


def splice(markdown: str, found: list[tuple[int, int, str]], texts: list[str]) -> str:
    for (a, b, _), t in sorted(zip(found, texts, strict=True), reverse=True):
        markdown = markdown[:a] + t + markdown[b:]
    return markdown


def complaint(problems: list) -> str:
    """The comment that stands for a schema with errors."""
    return f"<!-- {'; '.join(d.format() for d in problems).replace('--', '- -')} -->"


def render_markdown(markdown: str, **options) -> tuple[str, list]:
    """Fences replaced by SVG; one that has errors becomes a comment that says so, and its diagnostics are returned."""
    found, texts, problems = fences(markdown), [], []
    for _, _, source in found:
        text, diagnostics = render(source, **options)
        problems += diagnostics
        texts.append(text or complaint(diagnostics))
    return splice(markdown, found, texts), problems
