import json

import pytest

from adtflow.plans import edits, lang, model, text

SOURCE = """adtflow
type User<T> { id: Uuid, tags: List<Tag>, extra: Option<T> }
@targets(rust, go)
untagged union Tag {
  Plain(String)
  Num = 3
  Both { a: User<Int>, b: Missing }
}
alias Name = String # a comment
async function find<T>(what: T, n: Int) -> Option<User<T>>
function over {
  async (a: Int) -> Int
  (b: String) -> Int
}
"""


def test_tokens_have_places_and_bad_characters_are_reported():
    tokens, problems = lang.tokenize("type A {\r\n x: -1_0 $ -> }")
    assert [t.kind for t in tokens] == ["TypeKw", "Ident", "LBrace", "Newline", "Ident", "Colon", "Number", "Arrow", "RBrace", "EOF"]
    assert (tokens[4].line, tokens[4].col, tokens[4].offset) == (2, 2, 11)
    assert [(p.message, p.line, p.col) for p in problems] == [("unexpected character '$'", 2, 10)]


def test_parse_reads_all_kinds():
    parsed = lang.parse(SOURCE)
    assert parsed.ok
    assert [(d.kind, d.name) for d in parsed.decls] == [("record", "User"), ("union", "Tag"), ("alias", "Name"), ("function", "find"), ("function", "over")]
    tag = parsed.decls[1]
    assert tag.untagged and tag.targets == ("rust", "go") and tag.variants[1].discriminant == "3" and tag.variants[0].is_tuple
    assert parsed.decls[3].signatures[0].is_async and [s.is_async for s in parsed.decls[4].signatures] == [True, False]


@pytest.mark.parametrize(
    ("source", "message"),
    [
        ("type A { x UUID }", "expected ':', got 'UUID'"), ("@later(x) type A { }", "unknown annotation '@later'"), ("untagged type A {}", "expected 'union' after 'untagged', got 'type'"),
        ("banana", "expected 'type', 'union', 'untagged union', 'alias', or 'function', got 'banana'"), ("union U { A = x }", "expected numeric discriminant, got 'x'"),
    ],
)
def test_errors_are_rows_and_reading_goes_on(source, message):
    parsed = lang.parse(source + "\ntype Last { y: Int }")
    assert message in [p.message for p in parsed.diagnostics]
    assert parsed.decls[-1].name == "Last"


def test_null_and_empty_sources():
    assert lang.parse(None).decls == [] and lang.parse("").ok and lang.parse("adtflow\n").ok


def test_model_resolution_edges_externals():
    m = model.build(SOURCE)
    assert m.externals == ["List", "Missing", "Option"]
    assert {(e.source, e.target, e.kind, e.label) for e in m.edges} == {
        ("User", "Tag", "genericArg", "tags"), ("Tag", "User", "variantPayload", "Both.a"), ("find", "User", "genericArg", "return"),
    }
    assert [d.message[:22] for d in model.validate_for_codegen(m, "python")] == []
    assert [d.message[:22] for d in model.validate_for_codegen(m, "go")] == ["unknown type 'Missing'"]


def test_duplicates_and_arity():
    m = model.build("type A<T> { x: T }\ntype A { y: Int }\ntype B { a: A }")
    assert [d.message for d in m.diagnostics] == ["duplicate declaration 'A'", "type 'A' takes 1 type argument(s), got 0"]
    assert [d.message for d in model.validate(m)] == ["type 'A' takes 1 type argument(s), got 0"]
    assert m.diagnostics[0].format() == "2:1     error   duplicate declaration 'A'"


def test_a_declaration_hides_a_primitive_and_a_parameter_hides_both():
    m = model.build("alias Uuid = String\ntype A<Uuid> { x: Uuid }\ntype B { x: Uuid }")
    assert m.get("A").fields[0].type.resolution == "typeParam" and m.get("B").fields[0].type.resolution == "declared"


def test_text_and_json_round_trip():
    m = model.build(SOURCE)
    once = text.print_source(m)
    assert text.print_source(model.build(once)) == once and once.endswith("Int\n}\n")
    assert text.print_source(text.from_json(text.to_json(m))) == once
    assert "  Both { a: User<Int>, b: Missing }" in once and "  Plain(String)" in once and "  Num = 3" in once


@pytest.mark.parametrize(("j", "message"), [("[]", "model JSON must be an object"), ('{"version": 2}', "unsupported schema version 2"), ('{"version": 1}', "missing 'decls' array")])
def test_json_shape_errors(j, message):
    assert text.from_json(j).diagnostics[0].message == message
    assert text.from_json(json.dumps({"version": 1, "decls": [{"kind": "odd", "name": "x"}]})).diagnostics


def test_builders():
    m = model.Builder().add(model.record("A", {"x": "Int", "b": model.ref("List", "B")}), model.union("B", {"N": None, "S": {"_0": "A"}}), model.alias("C", "A"), model.function("f", {"a": "A"}, "C")).build()
    assert m.ok and [d.name for d in m.decls] == ["A", "B", "C", "f"] and len(m.edges) == 5


def test_edits():
    source = text.print_source(model.build("type A { x: Int, b: B<Int> }\nunion B<T> { Some(T), None }"))
    assert "type Z {\n  x: Int" in edits.rename_declaration(source, "A", "Z")[0]
    assert "b: Q<Int>" in edits.rename_declaration(source, "B", "Q")[0]
    assert edits.rename_declaration(source, "A", "B") == (source, [lang.Diagnostic("'B' is already declared")])
    assert "NewType {" in edits.add_declaration(source, "record")[0] and "NewType2" in edits.add_declaration(edits.add_declaration(source, "record")[0], "record")[0]
    assert "union B" not in edits.remove_declaration(source, "B")[0]
    assert "y: String" in edits.edit_row(source, "A", 0, "y", "String")[0]
    assert edits.edit_row(source, "A", 9, "y")[1]
    assert "  b2: B<String>" in edits.connect(source, "A", None, "B")[0] and "x: B<String>" in edits.connect(source, "A", 0, "B")[0]
    assert "  field: String" in edits.add_row(source, "A")[0] and "  Variant" in edits.add_row(source, "B")[0]
    assert "x: Int" not in edits.remove_row(source, "A", 0)[0]
    assert edits.add_row("type {", "A")[1]
