"""The Markdown scanner on cases worked by hand."""

import pytest

from leafgraph.functions.markdown import scan
from leafgraph.operators.text_inventory import fence_inventory, host_endings, link_inventory

ENDINGS = frozenset("com org net md de example io rs py sh fr".split())
T = "`" * 3
CASES = [
    (f"{T}py\n[a](b)\nhttp://x.com\n{T}\n",['py'],[]),
    ("`[q](code)` [r](s)",[],['s']),
    ("[a](b(c)d)",[],['b(c)d']),
    ("<http://auto.example/>",[],['http://auto.example/']),
    ("see www.x.org now",[],['http://www.x.org']),
    ("[r][1]\n\n[1]: /u 'T'\n",[],['/u']),
    (f"{T}js\nno end",['js'],[]),
    (f"- item\n\n  {T}sh\n  x\n  {T}\n- b",['sh'],[]),
    (f"1. a\n   ~~~ mermaid x\n   g\n   ~~~",['mermaid'],[]),
    (f"{T}a`b\ntext\n",[],[]),
    (f"{T}`\n{T}\nx\n{T}`\n",[''],[]),
    (f"> {T}c\n> code\nafter [l](m)",['c'],['m']),
    (f"    {T}py\n    [x](y)\n",[],[]),
    ("para\n    [x](y)\n",[],['y']),
    ("[a](<b c> \"t\")",[],['b%20c']),
    ("[a](b c)",[],[]),
    ("![i](x.png) [![i](x.png)](big)",[],['big']),
    ("[a [b](c) d](e)",[],['c']),
    ("\\[a](b) and [c\\]](d)",[],['d']),
    ("[x](javascript:alert(1)) [y](data:text/html,x)",[],[]),
    ("[foo]: <my url>\n\n[Foo][] [foo] [foo][bar]",[],['my%20url','my%20url']),
    ("http://a.com/x_(y). (http://b.com/z) **http://c.com**",[],['http://a.com/x_(y)','http://b.com/z','http://c.com']),
    ("mail me@x.org or <you@y.org>",[],['mailto:you@y.org','mailto:me@x.org']),
    ("README.md and main.cs, a.b, e.g. this",[],['http://README.md']),
    ("# Head [a](b) #\n\nT [c](d)\n===\n",[],['b','d']),
    ("* * *\n- a\n  - [b](c)\n\n        [code](no)\n",[],['c']),
    ("`` a ` [n](o) `` [p](q)",[],['q']),
    ("` [n](o)",[],['o']),
    ("a\n1) [x](y)\n2) z",[],['y']),
    ("a\n2) [x](y)",[],['y']),
    (f"{T}\na\n~~~\n{T}\n~~~x\nb\n~~~",['','x'],[]),
    (f"  {T}\n a\n   {T}  \nend [z](z)",[''],['z']),
    (f"{T}\na\n    {T}\n[b](c)",[''],[]),
    (f"- {T}x\n\n  a\n\nb [c](d)",['x'],['d']),
    (f"> a\n{T}py\nx\n{T}",['py'],[]),
    ("-\n\n  [a](b)",[],['b']),
    ("[a]( /u\n 'ti\ntle' )",[],['/u']),
    ("[](x) [a]() é [é](ü)",[],['x','','%C3%BC']),
    ("[a](b\\)c) [d](e&amp;f)",[],['b)c','e&f']),
    ("<not a link> <a:b> <x@y>",[],['mailto:x@y']),
    ("<ab:c>",[],['ab:c']),
    ("\t[a](b)\n",[],[]),
    ("- a\n\n\t[a](b)\n",[],['b']),
    (f"{T} \n{T}\n{T}java script\n{T}",['','java'],[]),
    ("\u00a0[a](b)\r\n\r\n[c]: d\r\n[c]",[],['b','d']),
    ("[a]: b\n[c]: d 'x\ny'\n[e]: f g\n[a][a][c] [e]",[],['b','d']),
    ("x https://h.org/?q=1&b=2, ftp://f.org/ HTTP://UP.org",[],['https://h.org/?q=1&b=2','ftp://f.org/','HTTP://UP.org']),
]


@pytest.mark.parametrize(("text", "languages", "hrefs"), CASES)
def test_cases(text, languages, hrefs):
    assert scan(text, ENDINGS) == (languages, hrefs)


def test_texts_that_go_on_and_on():
    """None of these takes more than time in proportion."""
    for text in ("[" * 50_000, "[a](" * 20_000, "`" * 20_000 + " a " + "``" * 10_000, "> " * 500 + "x", "![" * 30_000 + "](" * 30_000, "[a]: b\n" * 20_000, "a@" * 20_000, "- " * 300 + "x"):
        scan(text, ENDINGS)
    assert scan("[a](" * 20_000 + "b" + ")" * 20_000, ENDINGS)[0] == []


def test_inventories(spark):
    content = spark.createDataFrame([(1, f"{T}py\nx\n{T}\n[a](b)"), (1, f"{T}py\n{T}\nhttp://x.fr/ README.md a.gb"), (2, None), (3, ""), (None, f"~~~\n[a](b)\n~~~\n<HTTPS://y>")], "file_id long, text string")
    assert sorted(map(tuple, fence_inventory(content).collect()), key=repr) == sorted([(1, "py", "code", 2), (None, "", "plain", 1)], key=repr)
    assert sorted(map(tuple, link_inventory(content).collect())) == [("HTTPS://y", True, 1), ("b", False, 1), ("http://README.md", True, 1), ("http://x.fr/", True, 1)]
    assert link_inventory(content.limit(0)).isEmpty() and {"de", "io", "uk", "com"} <= host_endings(spark)
