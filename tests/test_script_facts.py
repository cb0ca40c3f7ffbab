"""Every rule of the facts that are read from TypeScript and JavaScript."""

from stratalens.sources.script_facts import facts_of, lexed


def got(src, fact, *at, path="f.tsx"):
    return [tuple(r[i] for i in at) for r in facts_of(path, src) if r[0] == fact]


def symbols(src):
    return {(r[2], r[3], r[6]) for r in facts_of("f.tsx", src) if r[0] == "symbol"}


def calls(src):
    return [(r[2], r[9]) for r in facts_of("f", src) if r[0] == "call"]


def test_functions_and_generators():
    src = "export function one(a, { b, c = (1) }) { return 2 }\nfunction* many(n) { yield n }\nasync function late(): Promise<void> {}\nexport default function Page() {\n  return <div>x</div>\n}\n"
    assert symbols(src) == {("one", "function", True), ("many", "function", False), ("late", "function", False), ("Page", "component", True)}
    assert got(src, "symbol", 2, 4, 5)[-1] == ("Page", 4, 6)
    assert got(src, "symbol", 8)[0][0] == ["(a, { b, c = (1) })"]


def test_declared_arrows_and_wrappers():
    src = """
export const a = (x: number): string => { return '' }
const b = async x => x, c = 3, d = function (y) { return y }
let e = useCallback(async () => { go() }, [])
var f = React.memo(forwardRef((props, ref) => <b ref={ref} />))
const g = useMemo(value, [value])
const h: (n: number) => void = (n) => {}
const i = lazy(() => import('./x'))
const j = other(() => 1)
const View = () => (
  <p>hi</p>
)
"""
    assert symbols(src) == {("a", "arrow_const", True), ("b", "arrow_const", False), ("d", "arrow_const", False), ("e", "arrow_const", False), ("f", "component", False), ("h", "arrow_const", False), ("i", "arrow_const", False), ("View", "component", False)}
    assert got(src, "symbol", 2, 4, 5)[-1] == ("View", 10, 12)


def test_classes_and_methods():
    src = "export class Store<T> extends Base {\n  count = 0\n  static async load(id: string): Promise<T> { return fetch(id) }\n  get size() { return this.count }\n  *each() { if (this.count) { yield 1 } }\n  #own(a) {\n    while (a) { a-- }\n  }\n  handler = () => { run() }\n  constructor(x) { super(x) }\n}\n"
    assert symbols(src) == {("Store", "class", True), ("load", "method", False), ("size", "method", False), ("each", "method", False), ("#own", "method", False), ("constructor", "method", False)}
    assert ("fetch", "f::Store.load") in calls(src) and ("super", "f::Store.constructor") in calls(src)


def test_exported_only_at_the_export_itself():
    src = "export function outer() {\n  const inner = () => 1\n  function deep() {}\n}\nexport const k = () => { const m = () => 2 }\n"
    assert symbols(src) == {("outer", "function", True), ("inner", "arrow_const", False), ("deep", "function", False), ("k", "arrow_const", True), ("m", "arrow_const", False)}


def test_calls_and_their_scopes():
    src = """
start()
function outer(cb) {
  a.b.c(1)
  list[0].run(x)
  make(2)(3)
  api?.get?.('/x')
  await load<User>(id)
  new Thing(4)
  items.map(function (z) { return inner(z) }).filter(Boolean)
  if (x) { while (y) { loop() } }
  const local = () => { nested() }
  const o = { method(q) { return within(q) }, async other() {} }
  return `t ${text(o)} (no)` + /re(g)/.test(s) // comment(x)
}
"""
    assert calls(src) == [
        ("start", "f::<module>"), ("a.b.c", "f::outer"), ("list[0].run", "f::outer"), ("make", "f::outer"), ("make(2)", "f::outer"), ("api.get", "f::outer"), ("load", "f::outer"),
        ("items.map", "f::outer"), ("inner", "f::outer"), ("items.map(function(z){returninner(z)}).filter", "f::outer"), ("loop", "f::outer"), ("nested", "f::outer.local"), ("within", "f::outer"), ("text", "f::outer"), ("/re(g)/.test", "f::outer"),
    ]
    assert [r[3] for r in facts_of("f", src) if r[0] == "call"][1:3] == ["c", "run"]
    assert calls("x." + "a" * 80 + "()") == []
    assert calls("const f = <p>Call us (now) don't</p>; go()") == [("go", "f::<module>")]


def test_imports():
    src = "import d, { a, b as c, type T } from '@/x'\nimport * as ns from \"./y\"\nimport './side.css'\nimport type { U } from '../u'\n// import z from 'no'\nconst s = \"import q from 'no'\"\n"
    assert got(src, "import", 2, 8) == [("@/x", ["a", "c", "T", "d"]), ("./y", ["ns"]), ("./side.css", []), ("../u", ["U"])]


def test_jsx_references():
    src = "const v = <Card a={1}><Icon /><span/></Card>\nconst m: Map<Key, Item> = f<Other>(x)\n"
    assert got(src, "jsx", 2) == [("Card",), ("Icon",)]


def test_ui_strings():
    long = "字" * 201
    src = f"const a = '登录'; const b = `共 ${{n}} 条`; const c = \"plain\"; const d = '{long}'; const e = '{'字' * 160}'\nconst v = <p>欢迎 回来</p>; const w = <b>字</b> // '注释'\n"
    rows = got(src, "ui", 2, 3)
    assert ("登录", "string") in rows and ("欢迎 回来", "jsx_text") in rows and ("字" * 150, "string") in rows and (" 条", "string") in rows
    assert len([r for r in rows if r[1] == "string"]) == 4 and len([r for r in rows if r[1] == "jsx_text"]) == 1


def test_broken_and_empty_files():
    for src in ("", "\n", "function", "function f(", "class {", "const a = (", "`${", "'", "/*", "export", "}}}((", "const x = () =>", "import"):
        list(facts_of("f", src))
        assert len(lexed(src)[0]) >= len(src)
