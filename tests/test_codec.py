import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adtflow.functions import codec, wire
from adtflow.plans.layout import LayoutError, Layouts
from adtflow.plans.model import build

PERSON = """type Person { name: String, age: Int, active: Bool, score: Float, address: Option<Address>, nickname: Option<String>, contact: Contact }
type Address { street: String, zip: Int }
union Contact { Email(EmailContact), Phone(PhoneContact) }
type EmailContact { addr: String }
type PhoneContact { number: Int, country: Int }
type PersonBatch { people: List<Person> }
type ContactBatch { contacts: List<Contact> }
"""

# Published layout hashes of these types at both layouts.
HASHES = {
    (1, "Person"): 0x2EE7A5DBF1C161BE, (1, "Address"): 0x71DB7B84F0734EEC, (1, "EmailContact"): 0x9476640EF36289D2, (1, "PhoneContact"): 0x71F0BB61837C895A, (1, "Contact"): 0x370A35F462F7514D,
    (2, "PersonBatch"): 0x364EF899D44B54EC, (2, "ContactBatch"): 0x81DB0E39D4D2E092,
}

# Published bytes of two messages at layout 1.
EMAIL = "000000000100010000000000000000000000000000000100010000008a00000061646140616e616c79746963616c2e756b00000000000000"
PHONE = "00000000010001000100000000000000000000000200000017070000000000002c00000000000000"


@pytest.fixture(scope="module")
def rows():
    return Layouts(build(PERSON), 1)


@pytest.fixture(scope="module")
def columns():
    return Layouts(build(PERSON), 2)


def test_hashes(rows, columns):
    for (major, name), value in HASHES.items():
        assert (rows if major == 1 else columns).hash(name) == value, name


def test_manifest_has_no_names(rows):
    other = Layouts(build(PERSON.replace("Person", "Human").replace("street", "road")), 1)
    assert other.manifest("Human") == rows.manifest("Person")
    assert rows.manifest("Address") == "tdbin-layout v1 major=1\n0:record d=1 p=1 [str@p0;i64@w0]"


def test_golden_bytes(rows):
    assert codec.encode(rows, "Contact", ("Email", {"addr": "ada@analytical.uk"})).hex() == EMAIL
    assert codec.encode(rows, "Contact", ("Phone", {"number": 1815, "country": 44})).hex() == PHONE
    assert codec.decode(rows, "Contact", bytes.fromhex(PHONE)) == ("Phone", {"number": 1815, "country": 44})


text = st.text(max_size=12)
long = st.integers(-(2**63), 2**63 - 1)
address = st.fixed_dictionaries({"street": text, "zip": long})
contact = st.one_of(st.tuples(st.just("Email"), st.fixed_dictionaries({"addr": text})), st.tuples(st.just("Phone"), st.fixed_dictionaries({"number": long, "country": long})))
person = st.fixed_dictionaries(
    {"name": text, "age": long, "active": st.booleans(), "score": st.floats(allow_nan=False), "address": st.none() | address, "nickname": st.none() | text, "contact": contact}
)


@settings(max_examples=60, deadline=None)
@given(st.lists(person, max_size=6), st.sampled_from(["bare", "framed", "packed", "elided"]), st.sampled_from([1, 2]))
def test_any_batch_round_trips(people, mode, major):
    layouts = Layouts(build(PERSON), major)
    data = codec.encode(layouts, "PersonBatch", {"people": people}, mode)
    wire.verify(data)
    assert codec.decode(layouts, "PersonBatch", data) == {"people": people}


WIDE = """type Wide { b: Bool, bs: List<Bool>, i: List<Int>, f: List<Float>, s: List<String>, y: List<Bytes>, u: Uuid, d: Decimal, ou: Option<Uuid>, t: DateTime, ot: Option<DateTime>, e: List<Color>,
  us: List<Uuid>, ol: Option<List<Bool>>, deep: List<Node>, g: Box<Int>, n: Unit, al: Name }
union Color { Red, Green, Blue }
type Node { name: String, kids: List<Inner>, one: Option<Inner>, c: Color, xs: List<Int>, w: Option<Int>, z: Bytes }
type Inner { v: Float, tags: List<String> }
type Box<T> { item: T, many: List<T> }
alias Name = String
"""


def wide_value():
    import decimal

    inner = {"v": -0.0, "tags": ["a", ""]}
    node = {"name": "n", "kids": [inner, {"v": 2.5, "tags": []}], "one": inner, "c": ("Green", None), "xs": [5, -7, 2**62], "w": None, "z": b"\0\xff"}
    return {
        "b": True, "bs": [True, False] * 40, "i": [1, -1, 2**63 - 1, -(2**63)], "f": [math.inf, -0.5], "s": ["ä", "", "x" * 300], "y": [b"", b"\x01"], "u": bytes(range(16)), "d": decimal.Decimal("-12.345"),
        "ou": bytes(16), "t": 1_700_000_000_000_001, "ot": None, "e": [("Blue", None), ("Red", None)], "us": [bytes(range(16)), bytes(16)], "ol": [], "deep": [node, node | {"one": None, "w": -3}], "g": {"item": 4, "many": [1]}, "al": "alias",
    }


@pytest.mark.parametrize("major", [1, 2])
def test_all_kinds_of_fields(major):
    layouts = Layouts(build(WIDE), major)
    value = wide_value()
    assert codec.decode(layouts, "Wide", codec.encode(layouts, "Wide", value, "packed")) == value
    assert math.copysign(1, codec.decode(layouts, "Wide", codec.encode(layouts, "Wide", value))["deep"][0]["kids"][0]["v"]) == -1


@pytest.mark.parametrize("major", [1, 2])
def test_changed_bytes_give_codes_and_never_crash(major):
    layouts = Layouts(build(WIDE), major)
    data = codec.encode(layouts, "Wide", wide_value())
    codes = set()
    for i in range(0, len(data), 3):
        for flip in (0x01, 0x80, 0xFF):
            bad = bytearray(data)
            bad[i] ^= flip
            _, code = wire.code_of(codec.decode, layouts, "Wide", bytes(bad), False)
            codes.add(code)
    for n in range(0, len(data), 8):
        codes.add(wire.code_of(codec.decode, layouts, "Wide", data[:n], False)[1])
    assert codes - {None} <= set(wire.DECODE_CODES) and len(codes) > 5


def test_appended_fields_are_compatible_both_ways():
    old, new = Layouts(build("type R { id: Int, name: String }")), Layouts(build("type R { id: Int, name: String, age: Int, tags: List<String> }"))
    assert codec.decode(new, "R", codec.encode(old, "R", {"id": 7, "name": "a"})) == {"id": 7, "name": "a", "age": 0, "tags": []}
    assert codec.decode(old, "R", codec.encode(new, "R", {"id": 7, "name": "a", "age": 3, "tags": ["x"]})) == {"id": 7, "name": "a"}
    assert wire.code_of(codec.decode, old, "R", codec.encode(new, "R", {"id": 1, "name": "", "age": 0, "tags": []}, "framed"))[1] == "HashMismatch"


def test_unknown_variant_and_null_root():
    a, b = Layouts(build("union U { A, B }")), Layouts(build("union U { A, B, C }"))
    assert wire.code_of(codec.decode, a, "U", codec.encode(b, "U", ("C", None)))[1] == "UnknownVariant"
    assert wire.code_of(codec.decode, a, "U", bytes(8))[1] == "NullRoot"
    assert wire.code_of(codec.decode, a, "U", b"")[1] == "BadLength"


@pytest.mark.parametrize("field", ["Map<String, Int>", "Any", "Option<Option<Int>>", "List<List<Int>>", "Missing"])
def test_types_without_a_layout_are_named(field):
    with pytest.raises(LayoutError):
        Layouts(build(f"type R {{ x: {field} }}")).plan("R")


def test_recursive_types():
    layouts = Layouts(build("type Tree { v: Int, kids: List<Tree>, up: Option<Tree> }"), 1)
    value = {"v": 1, "kids": [{"v": 2, "kids": [], "up": None}], "up": None}
    assert codec.decode(layouts, "Tree", codec.encode(layouts, "Tree", value)) == value
    for _ in range(80):
        value = {"v": 0, "kids": [], "up": value}
    assert wire.code_of(codec.encode, layouts, "Tree", value)[1] == "LimitExceeded"


@settings(max_examples=80, deadline=None)
@given(st.lists(long, max_size=40))
def test_delta_blocks(values):
    block = wire.block_encode(values)
    assert wire.block_decode(block).tolist() == values
    if values:
        assert wire.block_count(block) == len(values)
        assert len(block) == wire.block_length(len(values), block[20])
        assert wire.code_of(wire.block_decode, block + b"\0")[1] == "MalformedColumn"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 255, 0xFF00, 2**64 - 1, 0x0102030405060708]) | st.integers(0, 2**64 - 1), max_size=40))
def test_packing(words):
    body = b"".join(w.to_bytes(8, "little") for w in words)
    assert wire.unpack(wire.pack(body)) == body


def test_packing_vectors():
    assert wire.pack(bytes.fromhex("0005000600000007")).hex() == "8a050607"
    assert wire.pack(bytes(24)).hex() == "0002" and wire.pack(bytes(8 * 300)).hex() == "00ff002b"
    assert wire.code_of(wire.unpack, b"\xff\x01")[1] == "PackedTruncated"


def test_frames():
    body = b"12345678"
    frame = wire.frame_encode(body, packed=True, schema_hash=5)
    assert wire.frame_decode(frame)[1:] == (True, 5) and wire.body_of(frame) == body and wire.frames(frame * 3) == [frame] * 3
    for bad, code in ((b"TDB2" + frame[4:], "BadMagic"), (frame[:4] + b"\2" + frame[5:], "BadVersion"), (frame[:5] + b"\7" + frame[6:], "ReservedBits"), (frame[:-1], "LengthMismatch"), (frame[:5], "LengthMismatch")):
        assert wire.code_of(wire.frame_decode, bad)[1] == code


def test_verification_rejects_aliasing_and_bad_pointers():
    def words(*w):
        return b"".join((x & wire.U64).to_bytes(8, "little") for x in w)

    assert wire.code_of(wire.verify, words(3))[1] == "ReservedPointerKind"
    assert wire.code_of(wire.verify, words(wire.struct_pointer(5, 1, 0)))[1] == "PointerOutOfBounds"
    both = words(wire.struct_pointer(0, 0, 2), wire.struct_pointer(1, 1, 0), wire.struct_pointer(0, 1, 0), 7)
    assert wire.code_of(wire.verify, both)[1] == "AmplificationExceeded"
    assert wire.code_of(wire.verify, words(wire.struct_pointer(-1, 0, 0)))[1] is None
    assert wire.fnv1a64("") == 0xCBF29CE484222325 and wire.fnv1a64("a") == 0xAF63DC4C8601EC8C


def test_hash_literals_guards_and_dynamic_fields(rows):
    from adtflow.plans.layout import hash_literal

    assert hash_literal(HASHES[1, "Person"]) == "0x2ee7_a5db_f1c1_61be"
    own = rows.hash("Person")
    assert rows.compatible("Person", None) and rows.compatible("Person", own) and not rows.compatible("Person", 7) and rows.compatible("Person", 7, frozen=(7,)) and not rows.compatible("Person", own, expected=7)
    assert codec.field([("a", 1), ("b", 2)], "b") == 2 and wire.code_of(codec.field, [("a", 1), ("a", 2)], "a")[1] and wire.code_of(codec.field, [], "a")[1]


def test_packing_by_whole_bodies_equals_packing_word_by_word():
    import random

    from adtflow.functions import wire

    def plain(body):
        out, words, i = b"", [body[k : k + 8] for k in range(0, len(body), 8)], 0
        while i < len(words):
            solid, j = bytes(b for b in words[i] if b), i + 1
            if not solid:
                while j < len(words) and j - i <= 255 and not any(words[j]):
                    j += 1
                out += bytes((0, j - i - 1))
            elif len(solid) == 8:
                while j < len(words) and j - i <= 255 and words[j].count(0) <= 1:
                    j += 1
                out += b"\xff" + words[i] + bytes((j - i - 1,)) + b"".join(words[i + 1 : j])
            else:
                out += bytes((sum(1 << k for k in range(8) if words[i][k]),)) + solid
            i = j
        return out

    rng = random.Random(3)
    for _ in range(300):
        body = b"".join(rng.choice([bytes(8), b"\7" * 8, bytes(8) * 300, b"\7" * 2400, b"\0" + b"\7" * 7, bytes(rng.choice([0, 9]) for _ in range(8))]) for _ in range(rng.randrange(9)))
        packed = wire.pack(body)
        assert packed == plain(body) and wire.unpack(packed) == body
        if packed:
            assert wire.code_of(wire.unpack, packed[:-1])[1] == "PackedTruncated" or wire.unpack(packed[:-1]) == body[: len(wire.unpack(packed[:-1]))]
            assert wire.code_of(wire.unpack, packed, len(body) - 1)[1] == "LimitExceeded"
