"""Type names of each language, both ways, and how to write a type."""

from __future__ import annotations

from adtflow.plans.lang import Ref

# The name in each language of each type of the schema language.
TO = {
    "typescript": {"Bool": "boolean", "Int": "number", "Float": "number", "String": "string", "Bytes": "Uint8Array", "Unit": "void", "List": "Array", "Map": "Map", "DateTime": "string", "Uuid": "string", "Decimal": "string", "Any": "unknown"},
    "python": {"Bool": "bool", "Int": "int", "Float": "float", "String": "str", "Bytes": "bytes", "Unit": "None", "List": "list", "Map": "dict", "Option": "Optional", "DateTime": "datetime.datetime", "Uuid": "uuid.UUID", "Decimal": "decimal.Decimal", "Any": "Any"},
    "rust": {"Bool": "bool", "Int": "i64", "Float": "f64", "String": "String", "Bytes": "Vec<u8>", "Unit": "()", "List": "Vec", "Map": "HashMap", "Option": "Option", "DateTime": "chrono::DateTime<chrono::Utc>", "Uuid": "uuid::Uuid", "Decimal": "rust_decimal::Decimal"},
    "go": {"Bool": "bool", "Int": "int64", "Float": "float64", "String": "string", "Bytes": "[]byte", "Unit": "struct{}", "DateTime": "time.Time", "Uuid": "string", "Decimal": "string", "Any": "any"},
    "csharp": {"Bool": "bool", "Int": "int", "Float": "double", "String": "string", "Bytes": "byte[]", "Unit": "void", "List": "List", "Map": "Dictionary", "Any": "object", "DateTime": "DateTimeOffset", "Uuid": "Guid", "Decimal": "decimal"},
    "fsharp": {"Bool": "bool", "Int": "int", "Float": "float", "String": "string", "Bytes": "byte[]", "Unit": "unit", "List": "list", "Map": "Map", "Option": "option", "DateTime": "DateTimeOffset", "Uuid": "Guid", "Decimal": "decimal", "Any": "obj"},
    "dart": {"Bool": "bool", "Int": "int", "Float": "double", "String": "String", "Bytes": "List<int>", "Unit": "void", "List": "List", "Map": "Map", "Any": "Object", "DateTime": "DateTime", "Uuid": "String", "Decimal": "String"},
    "protobuf": {"Bool": "bool", "Int": "int64", "Float": "double", "String": "string", "Bytes": "bytes", "Unit": "google.protobuf.Empty", "Any": "google.protobuf.Any", "DateTime": "google.protobuf.Timestamp", "Uuid": "string", "Decimal": "string"},
    "php": {"Bool": "bool", "Int": "int", "Float": "float", "String": "string", "Bytes": "string", "Unit": "null", "DateTime": "\\DateTimeImmutable", "Uuid": "string", "Decimal": "string", "Any": "mixed"},
    "typeshed": {"Bool": "bool", "Int": "int", "Float": "float", "String": "str", "Bytes": "bytes", "Unit": "None", "List": "list", "Map": "dict", "Option": "Optional", "DateTime": "datetime.datetime", "Uuid": "uuid.UUID", "Decimal": "decimal.Decimal", "Any": "Any"},
}

# The types of the schema language that names of each language mean.
FROM = {
    "typescript": {"boolean": "Bool", "number": "Int", "string": "String", "void": "Unit", "Uint8Array": "Bytes", "Array": "List", "ReadonlyArray": "List", "Map": "Map", "Record": "Map", "Set": "List", "Date": "DateTime", "unknown": "Any", "any": "Any"},
    "python": {"bool": "Bool", "int": "Int", "float": "Float", "str": "String", "bytes": "Bytes", "None": "Unit", "list": "List", "dict": "Map", "Optional": "Option", "List": "List", "Dict": "Map", "Set": "List", "set": "List", "Tuple": "List", "datetime.datetime": "DateTime", "datetime": "DateTime", "uuid.UUID": "Uuid", "UUID": "Uuid", "decimal.Decimal": "Decimal", "Decimal": "Decimal"},
    "rust": {"bool": "Bool", "i8": "Int", "i16": "Int", "i32": "Int", "i64": "Int", "i128": "Int", "isize": "Int", "u8": "Int", "u16": "Int", "u32": "Int", "u64": "Int", "u128": "Int", "usize": "Int", "f32": "Float", "f64": "Float", "String": "String", "str": "String", "Vec": "List", "HashSet": "List", "HashMap": "Map", "BTreeMap": "Map", "Option": "Option", "()": "Unit", "DateTime": "DateTime", "Uuid": "Uuid", "Decimal": "Decimal"},
    "go": {"bool": "Bool", "int": "Int", "int8": "Int", "int16": "Int", "int32": "Int", "int64": "Int", "uint": "Int", "uint8": "Int", "uint16": "Int", "uint32": "Int", "uint64": "Int", "float32": "Float", "float64": "Float", "string": "String", "error": "String", "any": "Any", "time.Time": "DateTime"},
    "csharp": {"bool": "Bool", "int": "Int", "long": "Int", "short": "Int", "byte": "Int", "float": "Float", "double": "Float", "decimal": "Decimal", "string": "String", "void": "Unit", "object": "Any", "List": "List", "IReadOnlyList": "List", "IEnumerable": "List", "IList": "List", "HashSet": "List", "Dictionary": "Map", "IDictionary": "Map", "DateTimeOffset": "DateTime", "DateTime": "DateTime", "Guid": "Uuid"},
    "fsharp": {"bool": "Bool", "int": "Int", "int64": "Int", "float": "Float", "double": "Float", "decimal": "Decimal", "string": "String", "unit": "Unit", "obj": "Any", "list": "List", "List": "List", "seq": "List", "array": "List", "option": "Option", "Option": "Option", "Map": "Map", "DateTimeOffset": "DateTime", "DateTime": "DateTime", "Guid": "Uuid"},
    "dart": {"bool": "Bool", "int": "Int", "double": "Float", "num": "Float", "String": "String", "void": "Unit", "List": "List", "Set": "List", "Map": "Map", "Object": "Any", "dynamic": "Any", "DateTime": "DateTime"},
    "protobuf": {"bool": "Bool", "int32": "Int", "int64": "Int", "uint32": "Int", "uint64": "Int", "sint32": "Int", "sint64": "Int", "fixed32": "Int", "fixed64": "Int", "sfixed32": "Int", "sfixed64": "Int", "float": "Float", "double": "Float", "string": "String", "bytes": "Bytes", "google.protobuf.Empty": "Unit", "google.protobuf.Any": "Any", "google.protobuf.Timestamp": "DateTime"},
    "php": {"bool": "Bool", "int": "Int", "float": "Float", "string": "String", "null": "Unit", "void": "Unit", "array": "List", "list": "List", "mixed": "Any", "\\DateTimeImmutable": "DateTime", "DateTimeImmutable": "DateTime"},
}
FROM["typeshed"] = FROM["python"] | {"Sequence": "List", "Iterable": "List", "Mapping": "Map"}


def write(language: str, t: Ref) -> str:
    """A type in the syntax of ``language``."""
    args = [write(language, a) for a in t.args]
    one = args[0] if len(args) == 1 else None
    if t.name == "Option" and one and language in ("typescript", "go", "csharp", "dart", "php", "fsharp"):
        return {"typescript": f"{one} | undefined", "go": f"*{one}", "csharp": f"{one}?", "dart": f"{one}?", "php": f"?{one}", "fsharp": f"{one} option"}[language]
    if t.name == "Option" and one and language == "typeshed":
        return f"{one} | None"
    if t.name == "List" and one and language in ("go", "fsharp"):
        return f"[]{one}" if language == "go" else f"{one} list"
    if t.name in ("List", "Map") and language == "php":
        return "array"
    if t.name == "Map" and len(args) == 2 and language == "go":
        return f"map[{args[0]}]{args[1]}"
    name = TO[language].get(t.name, t.name)
    if not args:
        return name
    left, right = ("[", "]") if language in ("python", "typeshed", "go") else ("<", ">")
    return f"{name}{left}{', '.join(args)}{right}"


def split_top(text: str, marks: str = ",") -> list[str]:
    """``text`` cut at marks that stand outside all brackets; empty parts left out."""
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        if c in "<([{":
            depth += 1
        elif c in ">)]}" and not (c == ">" and i and text[i - 1] in "-="):
            depth -= 1
        elif c in marks and depth == 0:
            out.append(text[begin:i])
            begin = i + 1
    return [p.strip() for p in [*out, text[begin:]] if p.strip()]


def parse(language: str, text: str, declared: set[str] = frozenset()) -> Ref:
    """A type of ``language``; declared names keep theirs."""
    of = lambda t: parse(language, t, declared)
    text = text.strip().strip("\"'")
    if language == "rust":
        import re

        text = re.sub(r"^&\s*('\w+\s*)?(mut\s+)?|^Box<(.*)>$", lambda m: m.group(3) or "", text).strip()
        text = "()" if text == "()" else text.split("::")[-1] if "<" not in text else text[text[: text.index("<")].rfind("::") + 2 if "::" in text[: text.index("<")] else 0 :]
        if text == "Vec<u8>":
            return Ref("Bytes")
        if text.startswith("DateTime<"):
            return Ref("DateTime")
    if text.startswith("(") and text.endswith(")") and len(text) > 2:
        return of(text[1:-1])
    parts = split_top(text, "|")
    if len(parts) > 1 and language in ("typescript", "python", "typeshed", "php"):
        some = [p for p in parts if p not in ("undefined", "null", "None")]
        inner = of(some[0]) if len(some) == 1 else Ref("Any")
        return Ref("Option", (inner,)) if len(some) < len(parts) else inner
    if text in ("byte[]", "[]byte", "Uint8Array"):
        return Ref("Bytes")
    if text.endswith("?") or text.startswith("?"):
        return Ref("Option", (of(text.strip("?")),))
    if text.startswith("*"):
        return Ref("Option", (of(text[1:]),))
    if text.startswith("map[") and language == "go":
        depth = next(i for i in range(4, len(text)) if text[i] == "]")
        return Ref("Map", (of(text[4:depth]), of(text[depth + 1 :])))
    if text.startswith("[]"):
        return Ref("List", (of(text[2:]),))
    if text.endswith("[]"):
        return Ref("List", (of(text[:-2]),))
    if language == "fsharp" and " " in text and text.split()[-1] in ("list", "option", "array", "seq"):
        head, word = text.rsplit(None, 1)
        return Ref(FROM[language][word], (of(head),))
    for left, right in (("<", ">"), ("[", "]")):
        if left in text and text.endswith(right):
            at = text.index(left)
            args = tuple(of(a) for a in split_top(text[at + 1 : -1]))
            name = text[:at].strip()
            if name in ("Annotated", "Final", "ClassVar", "Required", "NotRequired", "Readonly") and args:
                return args[0]
            if name == "Union":
                some = [a for a in args if a.name != "Unit"]
                inner = some[0] if len(some) == 1 else Ref("Any")
                return Ref("Option", (inner,)) if len(some) < len(args) else inner
            return Ref(name if name in declared else FROM[language].get(name, name.split(".")[-1]), args)
    text = text.lstrip("'") if language == "fsharp" else text
    return Ref(text if text in declared else FROM[language].get(text, text.split(".")[-1].lstrip("\\")))
