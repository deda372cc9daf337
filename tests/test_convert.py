import pytest

from adtflow.functions import convert, render
from adtflow.plans.model import build
from adtflow.plans.text import print_source

SOURCE = """adtflow
type User { id: Int, name: String, tags: List<String>, home: Option<Address>, meta: Map<String, Int>, when: DateTime }
type Address { street: String, zip: Int }
type Box<T> { item: T, more: List<T> }
union Shape { Circle { radius: Int }, Square { side: Int, label: Option<String> }, Nothing }
union Color { Red, Green }
alias Email = String
"""


@pytest.mark.parametrize("language", [x for x in convert.LANGUAGES if x != "typescript"])
def test_round_trip(language):
    model = build(SOURCE)
    assert print_source(convert.read(convert.emit(model, language), language)) == print_source(model)


def test_typescript_round_trip_but_for_dates():
    model = build(SOURCE.replace(", when: DateTime", ""))
    assert print_source(convert.read(convert.emit(model, "typescript"), "typescript")) == print_source(model)


@pytest.mark.parametrize("language", convert.LANGUAGES)
def test_nothing_found(language):
    for text in ("", None, "just words"):
        assert convert.read(text, language).diagnostics


def test_visibility_and_functions_are_left_out():
    text = convert.emit(build("@skipTargets(rust) type A { x: Int }\ntype B { y: Int }\nfunction f(a: Int) -> Int"), "rust")
    assert "struct A" not in text and "struct B" in text and "f(" not in text


def test_language_details():
    model = build("untagged union U { S(String), N(Int) }\ntype R { o: Option<Int>, x: List<List<Int>> }")
    assert "| string\n  | number;" in convert.emit(model, "typescript") and "o: number | undefined;" in convert.emit(model, "typescript")
    assert "#[serde(untagged)]" in convert.emit(model, "rust")
    assert "// @td-type: List<List<Int>>" in convert.emit(model, "protobuf")
    assert "class R(BaseModel):" in convert.emit(model, "python", style="pydantic")
    assert "*int64" in convert.emit(model, "go") and "int? o" in convert.emit(model, "csharp") and "int option" in convert.emit(model, "fsharp")


def test_generated_python_runs():
    space: dict = {"__name__": "generated"}
    code = convert.emit(build(SOURCE), "python").replace("from __future__ import annotations", "from __future__ import annotations\nimport sys, types\nsys.modules.setdefault('generated', types.ModuleType('generated'))")
    exec(compile(code.replace('"Nothing"', "str"), "generated", "exec"), space)  # noqa: S102
    assert space["Address"]("x", 1).zip == 1 and space["Color"].Red.value == "red"


def test_stub_files():
    text = "import sys\nclass A:\n    x: int\n    def m(self) -> A: ...\ndef f(a: int, *b: str) -> A[int]: ...\ndef f(a: str) -> None: ...\nasync def g() -> list[A]: ...\nif sys.platform == 'x':\n    class A:\n        y: str | None\n"
    model = convert.read(text, "typeshed")
    a, f = model.get("A"), model.get("f")
    assert [x.name for x in a.fields] == ["x", "y"] and a.generics == ("_T0",) and len(f.signatures) == 2
    assert str(model.get("g").signatures[0].returns) == "List<A<Any>>"


def test_boxes_and_svg():
    model = build("union U { A, B(U) }\ntype R { u: U, l: List<U> }")
    box = render.boxes(model)[0]
    assert box["header"] == "union U" and [r["text"] for r in box["rows"]] == ["A", "B(U)"] and box["rows"][1]["y"] > box["rows"][0]["y"]
    out, problems = render.svg(model, hooks={"node": lambda c, t: 1 / 0, "post": lambda c, t: t + "<!-- end -->"})
    assert out.endswith("<!-- end -->") and 'stroke-dasharray="3 3"' in out and len(problems) == 2
    assert render.measure("a漢", 10) == (16.0, 12.0) and render.midpoint([(0, 0), (4, 0), (4, 2)]) == (3.0, 0.0)


def test_markdown():
    good, bad = "```adtflow\ntype A { x: Int }\n```", "````adtflow\ntype {\n````"
    out, problems = render.render_markdown(f"# t\n{good}\n\n{bad}\n```sql\nx\n```\n")
    assert "<svg" in out and "<!-- " in out and "```sql" in out and problems


def test_stubs_keep_all_branches_and_functions():
    stub = """
import sys
if sys.version_info >= (3, 12):
    class A:
        x: int
    def f(a: int) -> str: ...
else:
    class A:
        y: str
        if sys.platform == "linux":
            z: bytes
        else:
            w: float
    if sys.platform == "win32":
        def g() -> int: ...
    else:
        async def g(b: str) -> int: ...
"""
    model = convert.read(stub, "typeshed")
    by_name = {d.name: d for d in model.decls}
    assert [f.name for f in by_name["A"].fields] == ["x", "y", "z", "w"]
    assert len(by_name["f"].signatures) == 1 and [s.is_async for s in by_name["g"].signatures] == [False, True]
    text = convert.emit(model, "typeshed")
    assert "def f(a: int) -> str: ..." in text and text.count("@overload") == 2 and "async def g(b: str) -> int: ..." in text
    again = {d.name: d for d in convert.read(text, "typeshed").decls}
    assert [len(again[n].signatures) for n in ("f", "g")] == [1, 2] and [f.name for f in again["A"].fields] == ["x", "y", "z", "w"]
