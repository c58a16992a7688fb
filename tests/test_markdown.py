"""Parsing of notes, and names and keys, without Spark."""

import pytest

from lakeloom.functions import identity as I
from lakeloom.functions import names as N
from lakeloom.plans import markdown as M


def links(text):
    return [(x["syntax"], x["raw_target"], x["path"], x["heading"], x["block_ref"], x["display"], x["embed"]) for x in M.scan_links(text.encode(), 0)]


def kinds(text):
    return [b["kind"] for b in M.parse(text.encode(), "a.md", b"")["blocks"]]


def test_no_links_in_code_escapes_and_fences():
    assert links("`[[a]]` ``x ` [[b]]`` \\[[c]] [[d]]") == [("wiki", "d", "d", None, None, None, False)]
    assert links("```\n[[a]]\n```\n~~~~\n[[b]]\n~~~\n[[c]]\n") == []
    assert links("    [[a]]\n\t[[b]]\n  [[c]]") == [("wiki", "c", "c", None, None, None, False)]


def test_wiki_parts():
    assert links("![[img.png#h|200]] [[n^b-1]] [[#only]]") == [("wiki", "img.png#h|200", "img.png", "h", None, "200", True), ("wiki", "n^b-1", "n", None, "b-1", None, False), ("wiki", "#only", None, "only", None, None, False)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[a [b] c](x(1).md)", [("markdown", "x(1).md", "x(1).md", None, None, "a [b] c", False)]),
        ("![p](<my file.png> \"t)\")", [("markdown", "my file.png", "my file.png", None, None, "p", True)]),
        ("[x](a%20b.md#H)[y](c.md#^id)", [("markdown", "a%20b.md#H", "a b.md", "H", None, "x", False), ("markdown", "c.md#^id", "c.md", None, "id", "y", False)]),
        ("[x](HTTPS://e.org/#a) [](y) [z]() [q](a", [("markdown", "HTTPS://e.org/#a", None, None, None, "x", False), ("markdown", "y", "y", None, None, "", False)]),
        ("[[open [t](u)", [("markdown", "u", "u", None, None, "t", False)]),
        ("[x](%zz)", [("markdown", "%zz", "%zz", None, None, "x", False)]),
    ],
)
def test_inline_links(text, want):
    assert links(text) == want


def test_blocks_and_sections():
    doc = M.parse("# A\r\n\r\none\r\ntwo ^id1\r\n## B\n> [!note] x\n\n> q\n\n$$x$$\n\n1) l\n\n- m\n# C\n```py\n# no\n".encode(), "f/n.md", b"x")
    assert [b["kind"] for b in doc["blocks"]] == ["heading", "paragraph", "heading", "callout", "quote", "math", "list", "list", "heading", "code"]
    assert [(s["heading"], s["heading_path"], len(s["blocks"])) for s in doc["sections"]] == [("A", ["A"], 8), ("B", ["A", "B"], 6), ("C", ["C"], 2)]
    assert doc["blocks"][1]["explicit_id"] == "id1" and doc["title"] == "A" and doc["blocks"][1]["comparison_text"] == "one\ntwo ^id1\n"
    assert kinds("####### x") == ["paragraph"] and kinds("#x\n\n\n") == ["paragraph"] and kinds("") == []


def test_frontmatter():
    doc = M.parse(b"\xef\xbb\xbf---\ntitle: T\naliases: [b, a, b]\ntags: one\nwhen: 2024-01-01\n...\nbody", "n.md", b"")
    assert (doc["title"], doc["aliases"], doc["tags"], doc["error"]) == ("T", ["a", "b"], ["one"], None) and '"when":"2024-01-01"' in doc["frontmatter"]
    assert doc["blocks"][0]["byte_start"] == len(b"\xef\xbb\xbf---\ntitle: T\naliases: [b, a, b]\ntags: one\nwhen: 2024-01-01\n...\n")
    assert "repeated" in M.parse(b"---\na: 1\na: 2\n---\n", "n.md", b"")["error"]
    assert M.parse(b"---\n- x\n---\n", "n.md", b"")["warning"] and M.parse(b"---\nopen", "n.md", b"")["frontmatter"] is None
    assert "not UTF-8" in M.parse(b"\xff", "n.md", b"")["error"] and M.parse(b"", "d/n.x.md", b"")["title"] == "n.x"


def test_keys():
    assert N.lookup_key(" Straße\u2003") == N.lookup_key("STRASSE") and N.lookup_key("e\u0301") == N.lookup_key("\u00c9")
    assert N.link_key("././A\\b") == "a/b" and N.collision("e\u0301", "\u00e9") == "unicode" and N.collision("a", "A") == "casefold"


def test_paths():
    assert N.resolve("a/b.md", "../c") == "c" and N.resolve("a/b.md", "../../c") is None and N.resolve("a/b.md", "/x//./y") == "x/y"
    assert [N.resolve_contained("a/b.md", t) for t in ("c", "../c", "", "/c", "x//y", "c:\\d", "C:x", "..", "a/")] == ["a/c", "c", None, None, None, None, None, None, None]
    assert N.relative("a/b/c.md", "a/d.md") == "../d.md" and N.relative("c.md", "d.md") == "d.md"
    assert N.render_target("markdown", "a b(1).md", "H #", None, "x") == "a%20b%281%29.md#H%20%23" and N.render_target("wiki", "a b", None, "i", "x") == "a b^i|x"
    assert N.percent_decode("a%C3%A9+") == "aé+" and N.percent_decode("%C3") is None and N.percent_decode("%g0") is None
    assert N.with_suffix("d/" + "é" * 200 + ".md", "~ABCDEFGH").encode().endswith(b"~ABCDEFGH.md") and len(N.with_suffix("é" * 200 + ".md", "~A").encode()) <= 240
    assert N.cut_filename("x" * 50 + ".png", 20) == "x" * 16 + ".png" and N.cut_utf8("éé", 3) == "é"
    assert [N.component_problem(c) for c in ("a", "a.", "con.txt", "x" * 241, "a:b", "COM1", "com10")] == [None, "not portable", "reserved", "too long", "not portable", "reserved", None]
    assert N.source_path("./a/e\u0301") == ("a/e\u0301", "a/\u00e9", None) and [N.source_path(p)[2] for p in ("/a", "a//b", "../a", "", ".")] == ["not a relative path with slashes", "not portable", "not portable", "not portable", "empty"]
    assert N.output_path_problem("a/b.md") is None and N.output_path_problem("./a") == "not canonical"


def test_identities():
    assert I.uleb128(0) == b"\0" and I.uleb128(300) == b"\xac\x02" and I.crockford(b"\xff" * 32, 8) == "ZZZZZZZZ"
    assert I.canonical_json({"b": [1, {"é": 2, "a": None}], "a": "x"}) == '{"a":"x","b":[1,{"a":null,"é":2}]}'
    for bad in ('{"a":1,"a":2}', '[{"x":{"y":1,"y":2}}]', "[NaN]", "[" * 100_000):
        with pytest.raises(ValueError):
            I.strict_json(bad)


def test_canvas():
    from lakeloom.plans import canvas as C

    got = C.parse(b'{"nodes":[{"id":"b","type":"file","file":"x.md","x":1,"c":{"z":1}},{"id":"a","type":"file","file":"y.md"}],"edges":[{"id":"e","fromNode":"a","toNode":"q"}]}')
    assert [r["path"] for r in got["refs"]] == ["y.md", "x.md"] and got["nodes"][0]["unknown"] == '{"c":{"z":1}}' and got["edges"][0]["toNode"] == "q"
    for bad in (b"[]", b"", b'{"nodes":[1]}', b'{"nodes":[{"id":"a"}]}', b'{"nodes":[{"id":"a","type":"t","x":1.5}]}', b'{"nodes":[{"id":"a","type":"t"},{"id":"a","type":"t"}]}', b'{"nodes":[{"id":"a","type":"file"}]}', b'{"a":1,"a":1}', b"\xff"):
        with pytest.raises(ValueError):
            C.parse(bad)


def test_sensitive_spans():
    from lakeloom.operators import sensitive as S

    got = [(k, a, b) for k, a, b, _ in S.spans('é (a@b@c.d), x@y. sk-sk-1"AKIA +49 (30) 1234-5678 -----BEGIN OPENSSH PRIVATE KEY-----')]
    assert ("email", 4, 11) in got and ("api_credential", 19, 26) in got and ("api_credential", 22, 26) in got
    assert [k for k, *_ in got if k in ("phone", "private_key", "cloud_credential")] == ["phone", "private_key"] and len(got) == 5
