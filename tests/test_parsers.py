import pytest

from corvine.sources.parsers import extension_of, parse_file, register, supported
from corvine.sources.parsers.vue import section


def brief(path, text):
    rows, error = parse_file(path, text.encode())
    assert error is None
    return [(r["kind"], r["name"], r["start_line"], r["end_line"], r["parent"]) for r in rows]


def test_java():
    text = """package a.b;
import static a.B.c;
@Service
public class Outer<T> extends Base<T> implements A, B<C> {
    private final Map<String, List<Integer>> cache = new HashMap<>(), other;
    @Inject public Outer(Repo r) { this.r = r; }
    @Override
    public <R> List<R> find(Long id) throws IOException { class Local {} return x; }
    abstract void none();
    enum Color { RED, GREEN { void f() {} }; int v; }
    interface I { int K = 1; void m(); }
    record Point(int x) { void area() {} }
}
"""
    assert brief("/A.java", text) == [
        ("Import", "static a.B.c", 2, 2, None),
        ("Class", "Outer", 3, 13, None),
        ("Field", "cache", 5, 5, "Outer"),
        ("Constructor", "Outer", 6, 6, "Outer"),
        ("Method", "find", 7, 8, "Outer"),
        ("Method", "none", 9, 9, "Outer"),
        ("Enum", "Color", 10, 10, None),
        ("Method", "f", 10, 10, "Color"),
        ("Field", "v", 10, 10, "Color"),
        ("Interface", "I", 11, 11, None),
        ("Method", "m", 11, 11, "I"),
        ("Method", "area", 12, 12, "Outer"),
    ]
    rows = {(r["kind"], r["name"]): r for r in parse_file("/A.java", text.encode())[0]}
    assert rows["Class", "Outer"]["dependencies"] == ["extends Base<T>", "implements A, B<C>"]
    assert rows["Class", "Outer"]["annotations"] == ["@Service"]
    assert rows["Method", "find"]["signature"] == "@Override\n    public <R> List<R> find (Long id) throws IOException"
    assert rows["Constructor", "Outer"]["signature"].endswith("{ this.r = r; }")
    assert rows["Field", "cache"]["signature"].startswith("private final Map")


def test_script():
    text = """import { A } from './x';
export class Foo<T> extends Bar {
  x = 1;
  static async load(id) { return `a${id + `}`}` }
  get value() { return /[/}]/.test(1) }
}
const a = () => 1, b = function (q) { };
const c = 1
export const f = (n) => n;
export default { methods: { z() {} } };
foo({ bar(p) { }, baz: 2 });
function* gen() { function inner() {} }
"""
    assert brief("/a.js", text) == [
        ("Import", "./x", 1, 1, None),
        ("Class", "Foo", 2, 6, None),
        ("Field", "x", 3, 3, "Foo"),
        ("Method", "load", 4, 4, "Foo"),
        ("Method", "value", 5, 5, "Foo"),
        ("Method", "a", 7, 7, None),
        ("Method", "b", 7, 7, None),
        ("Method", "f", 9, 9, None),
        ("Other", "export", 10, 10, None),
        ("Method", "bar", 11, 11, None),
        ("Method", "gen", 12, 12, None),
    ]
    rows = {r["name"]: r for r in parse_file("/a.js", text.encode())[0]}
    assert rows["f"]["content"] == "export const f = (n) => n;" and rows["f"]["signature"] == "f = (n) => ..."
    assert rows["Foo"]["content"].startswith("export class") and rows["Foo"]["dependencies"] == ["extends Bar"]


def test_typescript():
    text = """interface S { a: string; m(): void }
enum E { A }
@Dec({ a: 1 })
class T implements S {
  @Input() private v: number = 1;
  m(a: string): Promise<{ x: number }> { return null }
  n(): void;
}
const t: H<string> = async (e: X): Promise<void> => { };
"""
    assert [b[:2] for b in brief("/a.ts", text)] == [("Interface", "S"), ("Enum", "E"), ("Class", "T"), ("Field", "v"), ("Method", "m"), ("Method", "t")]
    assert [b[:2] for b in brief("/a.js", "interface\nenum2 = 3")] == []
    rows = {r["name"]: r for r in parse_file("/a.ts", text.encode())[0]}
    assert rows["T"]["annotations"] == ["@Dec({ a: 1 })"] and rows["v"]["annotations"] == ["@Input()"]
    assert rows["m"]["signature"] == "m (a: string) : Promise<{ x: number }>"


def test_component():
    text = """<template>
<p/>
</template>
<script setup lang="ts">
const emit = defineEmits(["x"])
withDefaults(defineProps<{ a: string }>(), {})
interface P { a: string }
const go = () => 1
</script>
"""
    assert brief("/a.vue", text) == [
        ("Other", "template", 1, 3, None),
        ("Other", "defineEmits", 5, 5, None),
        ("Other", "defineProps", 6, 6, None),
        ("Interface", "P", 7, 7, None),
        ("Method", "go", 8, 8, None),
    ]
    assert brief("/a.vue", '<script lang="ts" setup>\nconst a = () => 1\n</script>') == []
    both = "<script>\nimport a from 'a'\n</script>\n<script setup>\nfunction f() {}\n</script>"
    assert brief("/a.vue", both) == [("Import", "a", 2, 2, None), ("Method", "f", 5, 5, None)]
    assert section("<template", "template") is None and section("<template>x", "template") is None


def test_xml():
    text = '<beans>\n<bean id="a" class="X"/>\n<bean name="b">\n<property name="p"/>\n</bean></beans>'
    assert brief("/b.xml", text) == [("XmlNode", "beans", 1, 1, None), ("XmlNode", "a", 2, 2, None), ("XmlNode", "b", 3, 3, None)]
    assert parse_file("/b.xml", text.encode())[0][1]["signature"] == '<bean id="a" class="X"/>'
    mapper = '<mapper namespace="m.U">\n<select id="q"\n x="1">\nSELECT * FROM t WHERE a = #{id}\n<![CDATA[ JOIN u ]]></select>\n<sql id="c">x</sql>\n<update id="e"/>\n</mapper>'
    assert brief("/m.xml", mapper) == [("XmlNamespace", "m.U", 1, 1, None), ("XmlNode", "q", 3, 5, "m.U"), ("XmlNode", "c", 6, 6, "m.U")]
    rows = parse_file("/m.xml", mapper.encode())[0]
    assert rows[1]["dependencies"] == ["t", "param:id"] and rows[1]["signature"] == '<select id="q" x="1">'


@pytest.mark.parametrize(
    "text, want",
    [
        ('<a>&nbsp;<b id="1"/></a>', [("a", "<a>"), ("1", '<b id="1"/>')]),
        ("<a/><b/>", [("a", "<a/>"), ("b", "<b/>")]),
        ("", []),
        ("plain text, no markup & none", []),
        ('<?xml version="1.0" encoding="GBK"?><r>\u4e2d</r>', [("r", "<r>")]),
        ('<r id="a&amp;b" q=\'x>y\'/>', [("a&amp;b", '<r id="a&amp;b" q="x>y"/>')]),
        ("<a><b>", [("a", "<a>"), ("b", "<b>")]),
        ('<a id="1" id="2" bare x=3 y="4">t</a >', [("1", '<a id="1" y="4">')]),
        ('<!DOCTYPE r [<!ENTITY e "x">]><!-- <no> --><r><![CDATA[<no>]]><s/></r>', [("r", "<r>"), ("s", "<s/>")]),
        ("\ufeff<r/>", [("r", "<r/>")]),
    ],
)
def test_xml_is_read_leniently(text, want):
    rows, error = parse_file("/a.xml", text.encode())
    assert error is None and [(r["name"], r["signature"]) for r in rows] == want


def test_mapper_text_with_unknown_entities():
    text = '<mapper namespace="n"><select id="a">FROM t &lt; &#65;<b/>JOIN &what; u<i/> JOIN v</select></mapper>'
    rows, _ = parse_file("/m.xml", text.encode())
    assert rows[1]["dependencies"] == ["t", "v"]


@pytest.mark.parametrize("text", ["</a>", "<a></b>", "<a", "<!-- x", "<![CDATA[ x", "<? x", '<a b="', "<!what>"])
def test_xml_errors(text):
    assert parse_file("/a.xml", text.encode())[1]


@pytest.mark.parametrize("path, content", [("/a.xml", b"<a><b></a>"), ("/a.java", b"\xff"), ("/a.txt", b"x"), ("/a.java", None)])
def test_errors_belong_to_the_file(path, content):
    rows, error = parse_file(path, content)
    assert rows == [] and error


@pytest.mark.parametrize("path", ["/a.java", "/a.js", "/a.ts", "/a.vue"])
@pytest.mark.parametrize("text", ["", "{", "}}}", "class", "class A {", "import", "export", "const x =", "@", "function f(", "a<b<c", "'", "`${", "/*", "enum E { A("])
def test_broken_sources_do_not_break_the_parser(path, text):
    for source in (text, f"<script>{text}</script>"):
        assert parse_file(path, source.encode())[1] is None


def test_registry():
    assert supported("/x/a.vue") and not supported("/x/A.JAVA") and not supported("/x/java")
    assert extension_of("/a/.vue") is None
    before = parse_file("/a.java", b"import x;")
    register(("java",), lambda path, text, ext: [])
    assert parse_file("/a.java", b"import x;") == before
