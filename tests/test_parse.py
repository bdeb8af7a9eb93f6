import pytest

from sigsearch.operators.parse import ARITY_SLOT, RET_SLOT, parse_signatures

# text: (name, has_sig, argument count, return, unparsed)
ACCEPTED = {
    "fn (Option<Result<T, E>>) -> Result<Option<T>, E>>": (None, True, 1, "type", ">"),
    "()": (None, True, 0, "unit", ""),
    "()  ": (None, True, 0, "unit", ""),
    "(..)": (None, True, None, "unit", ""),
    "fn foo": ("foo", False, None, None, ""),
    " fn go(i32)": ("go", True, 1, "unit", ""),
    "\tgo": ("go", False, None, None, ""),
    "foo": ("foo", False, None, None, ""),
    "fn f(i32) -> bool": ("f", True, 1, "type", ""),
    "fn(i32) -> bool": (None, True, 1, "type", ""),
    "(i32) junk": (None, True, 1, None, "junk"),
    "(i32)   ->   ()": (None, True, 1, "unit", ""),
    "() -> (i32, u8)": (None, True, 0, "type", ""),
    "() -> Vec<T": (None, True, 0, "type", "<T"),
    "() -> (T": (None, True, 0, None, " -> (T"),
    "(IP)": (None, True, 1, "unit", ""),
    "( i32, _, x: _, y:, : u8)": (None, True, 5, "unit", ""),
    "fn foo(i32,)": ("foo", False, None, None, "(i32,)"),
    "() -> &": (None, True, 0, None, " -> &"),
}
REJECTED = [
    "", "  ", "(i32 , u8)", "(_x: i32)", "(&'a str)", "([u8; 4])", "(std::String)", "( )", "(i32,)", "((i32,))", "([])",
    "(Vec<T)", "(T1)", "(A_B)", "(Vec<T>u8)", "(.. )", "(i32", "-> i32", "(i32 x)", "(x : i32)", "(*u8)", "(Vec<T u>)",
]


@pytest.fixture(scope="module")
def parsed(spark):
    texts = [*ACCEPTED, *REJECTED, *NODES]
    rows = parse_signatures(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    return {r.text: r.sig for r in rows}


@pytest.mark.parametrize("text", ACCEPTED)
def test_accepted(parsed, text):
    s = parsed[text]
    assert (s.name, s.has_sig, s.n_args, s.ret, s.unparsed) == ACCEPTED[text]
    assert not s.rejected


@pytest.mark.parametrize("text", REJECTED)
def test_rejected(parsed, text):
    assert parsed[text].rejected and not parsed[text].nodes


# text: nodes as (slot, path, spine, refs, kind, name, children, canon)
NODES = {
    "(&mut Vec<&(T, _)>, [_], HTTPServer) -> !": [
        (ARITY_SLOT, "", "", [], "arity", None, 3, ""),
        (0, "", "", ["&m"], "path", "Vec", 1, "Vec<& (T,_)>"),
        (0, "0", "path", ["&"], "tuple", None, 2, "(T,_)"),
        (0, "0.0", "path.tuple", [], "generic", "T", None, "T"),
        (1, "", "", [], "slice", None, 1, "[_]"),
        (2, "", "", [], "path", "HTTPServer", None, "HTTPServer"),
        (RET_SLOT, "", "", [], "never", None, None, "!"),
    ],
    "(*const*mut u8, Vec<>, ()) -> Map<K,>": [
        (ARITY_SLOT, "", "", [], "arity", None, 3, ""),
        (0, "", "", ["*c", "*m"], "prim", "u8", None, "u8"),
        (1, "", "", [], "path", "Vec", 1, "Vec<_>"),
        (2, "", "", [], "tuple", None, 0, "()"),
        (RET_SLOT, "", "", [], "path", "Map", 2, "Map<K,_>"),
        (RET_SLOT, "0", "path", [], "generic", "K", None, "K"),
    ],
    "(.., i32)": [],
    "(string) -> T1": [
        (ARITY_SLOT, "", "", [], "arity", None, 1, ""),
        (0, "", "", [], "path", "string", None, "string"),
        (RET_SLOT, "", "", [], "generic", "T", None, "T"),
    ],
}


@pytest.mark.parametrize("text", NODES)
def test_nodes(parsed, text):
    got = [(n.slot, n.path, n.spine, n.refs, n.kind, n.name, n.n_children, n.canon) for n in parsed[text].nodes]
    assert got == NODES[text]


def test_deep_nesting(spark):
    depth = 60
    text = "(" + "Box<" * depth + "T" + ">" * depth + ")"
    (row,) = parse_signatures(spark.createDataFrame([(text,)], "text string")).collect()
    assert len(row.sig.nodes) == depth + 3
    assert max(n.path.count(".") for n in row.sig.nodes) == depth - 1
