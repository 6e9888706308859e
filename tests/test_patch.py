import random
import re

from pyspark.sql import functions as F

from commitloom.functions import patch as P

NAMES = [".py", "a.b.PY", "py", "x/.md", "a..py", "a.", "src/a.py", "d.py/readme", "a.rb/", "x.java", "a.md"]


def test_languages(values):
    v1 = [None, None, None, None, "Python", None, "Python", None, "Ruby", "Java", "Text"]
    assert values(NAMES, "string", P.language_v1) == v1
    v2 = ["Python", None, "Python", "Markdown", "Python", None, "Python", None, None, "Java", "Markdown"]
    assert values(NAMES, "string", P.language_v2) == v2
    raw = values(["a.js", "a.md", "x"], "string", P.language_raw)
    assert raw == ["Javascript", "Other", "Other"]
    compat = values(["a.js", "a.md"], "string", lambda f: P.language_raw(f, compat=True))
    assert compat == ["Other", "Other"]


LINES = {
    "@@ -1,2 +3,4 @@ def f():": ["<ide> def f():"],
    "@@ -1 +1 @@": [],
    "+@@ a @@": ["<add>"],
    "@@@ -1 -1 +1 @@@": ["<ide>@@"],
    "-": ["<del>"],
    "\\ No newline": ["<ide>\\ No newline"],
    "": [],
    " kept": ["<ide> kept"],
    "+a\n\n-b\r\n c +d": ["<add>a", "<del>b", "<ide> c", "<add>d"],
    "<ide>+x\n+<ide>-y\n+-z\n-+w": ["<ide><ide>+x", "<add><ide>-y", "<add>-z", "<del>+w"],
    "\n\n": [],
    "@@ a\n@@ b": ["<ide>@@ a", "<ide>@@ b"],
}


def test_tag_patch_golden(values):
    assert values(list(LINES), "string", P.tag_patch) == list(LINES.values())


def tagged(patch):
    """The definition, line by line."""
    lines = (re.sub("@@[^@]*@@", "", line) for line in patch.splitlines())
    tags = {"+": "<add>", "-": "<del>"}
    return [tags[x[0]] + x[1:] if x[0] in tags else "<ide>" + x for x in lines if x]


def test_tag_patch_agrees_on_noise(values):
    draw = random.Random(5)
    alphabet = "+-@@ a\n\r\x0b\x0c\x1c\x1d\x85  <ide>"
    noise = ["".join(draw.choices(alphabet, k=draw.randint(0, 40))) for _ in range(3000)]
    assert values(noise, "string", P.tag_patch) == [tagged(p) for p in noise]


API = "array<struct<filename:string,previous_filename:string,status:string,patch:string>>"
DRILL = "array<struct<path_before:string,path_after:string,patch:string>>"


def test_serialize_v1(values):
    commits = [
        [("a.py", None, "modified", "@@ -1 +1 @@\n+x\n-y"), ("b.py", "c.py", "renamed", " z")],
        [("a.py", None, "modified", "")],
        [("a.py", None, "modified", None), ("b.py", None, "modified", "+x")],
        [],
    ]
    want = [
        "<ide><path>a.py\n<add>x\n<del>y\n<add><path>b.py\n<del><path>c.py\n<ide> z",
        "<ide><path>a.py",
        None,
        "",
    ]
    assert values(commits, API, P.serialize_commit) == want


def test_serialize_v2(values):
    commits = [[("a", "a", "+x")], [(None, "n", "+x")], [("o", None, "-x")], [(None, None, "")]]
    want = [
        "<ide><path>a\n<add>x",
        "<add><path>n\n<del><path>None\n<add>x",
        "<add><path>None\n<del><path>o\n<del>x",
        "<ide><path>None",
    ]
    assert values(commits, DRILL, lambda f: P.serialize_commit(f, "v2")) == want


def test_scrub_runs_token_by_token(values):
    # the removal of <pad> forms an <s>, that of <s> forms a <mask>; <msg> went before
    texts = ["<<pad>s>a", "<ma<s>sk>b", "<m<s>sg>c", "<unk></s>"]
    assert values(texts, "string", P.scrub_special) == ["a", "b", "<msg>c", ""]


def test_untag(values):
    assert values(["<ide> a\n<add>b\n<del>c"], "string", P.untag) == [" a\n+b\n-c"]


def files(*names):
    return [(name, None, "modified", "+x") for name in names]


def test_content_type(values):
    commits = [
        files("a.py"),
        files("a.py", "b.go", "c.go"),
        files("a.py", "b.go"),
        files("a.py", "b.txt"),
        [],
    ]
    got = values(commits, API, P.content_type)
    assert [tuple(row) for row in got] == [
        ("Python", "Python"),
        ("Mixed", "Go"),
        ("Mixed", "Go"),
        (None, None),
        (None, None),
    ]


def test_mixed_content(values):
    kinds = [["Python"], ["Python", "Go"], ["Python", "Markdown"], ["Markdown"], ["Go", "PHP", "Markdown"], []]
    want = ["NO", "PL", "NL_ONLY", "NL_ONLY", "PL", "NO"]
    assert values(kinds, "array<string>", P.mixed_content) == want


def test_supported_files(values):
    commits = [files("a.py"), files("a.py", "b.txt"), []]
    assert values(commits, API, P.all_files_supported) == [True, False, False]
    got = values(commits, API, lambda f: P.all_files_supported(f, "v2"))
    assert got == [True, False, True]


def test_size_rule(values):
    commits = [[("a.py", None, "modified", "12345"), ("b.py", None, "modified", None)], []]
    assert values(commits, API, lambda f: P.fits_size(f, 5)) == [True, True]
    assert values(commits, API, lambda f: P.fits_size(f, 4)) == [False, True]


def test_keys(values):
    assert values(["a/b/c"], "string", P.repo_id) == ["a-b-c"]
    assert values(["a"], "string", lambda a: P.repo_key(a, F.lit("b-c"))) == ["a-b-c"]
