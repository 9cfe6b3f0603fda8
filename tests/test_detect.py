import pytest

from marginalia.functions import text as tx
from marginalia.operators import detect
from marginalia.operators.detect import detect_functions

CASES = {
    "a.py": ("import os\n@dec\ndef f(a,\n   b\n):\n    # c\n    return 1\n\n# tail\nclass K:\n    def m(self):\n"
             "        def inner():\n            pass\n        return 2\n\n\tx = 1\ndef g(): return 1\n",
             [("f", 3, 7), ("K:m", 11, 16), ("K:inner", 12, 13), ("g", 17, 17)]),
    "b.rs": ("struct S;\ntrait T { fn decl(&self); }\npub fn top<'a>(x: &'a str)\n    -> i32\n{\n  // }\n  let s = \"}\";\n"
             "  let c = '{';\n  if x { 1 } else { 2 }\n}\nimpl<T: Foo> Bar<T> for crate::S<T> {\n"
             "    pub(crate) async fn m(&self) -> i32 {\n  1\n }\n}\nfn one() { 1 }\n",
             [("top", 3, 10), ("S:m", 12, 14), ("one", 16, 16)]),
    "c.go": ("package x\nfunc (r *Srv) Do(a int) error {\n\treturn nil\n}\nfunc Plain() {\n}\n", [("Srv:Do", 2, 4), ("Plain", 5, 6)]),
    "d.js": ("export class A extends B {\n  constructor(x) {\n    if (x) {\n    }\n  }\n  async go(a, b) {\n  }\n}\n"
             "const f = (a) => {\n  return 1;\n};\nfunction h() {\n}\nfoo(function() {\n});\n",
             [("A:constructor", 2, 5), ("A:go", 6, 7), ("f", 9, 11), ("h", 12, 13)]),
    "e.java": ("package a;\npublic class M {\n  private int x = f(3);\n  public static void main(String[] args) throws E {\n"
               "    for (int i=0;i<1;i++) {\n    }\n  }\n  abstract void z();\n}\n", [("M:main", 4, 7)]),
    "f.cpp": ("int add(int a,\n  int b)\n{\n return a+b;\n}\nint proto(int);\nvoid K::run() const {\n  if (x) { y(); }\n}\n"
              "struct Q {\n  int get() { return 1; }\n};\n", [("add", 1, 5), ("K:run", 7, 9), ("Q:get", 11, 11)]),
    "h.sh": ("foo() {\n  echo\n}\nfunction bar {\n}\n", [("foo", 1, 3), ("bar", 4, 5)]),
    "i.r": ("f <- function(x) {\n x\n}\n", [("f", 1, 3)]),
    "j.pl": ("sub z {\n 1;\n}\n", [("z", 1, 3)]),
    "k.php": ("<?php\nclass A {\n public function b() {\n }\n}\nfunction c() {\n}\n", [("A:b", 3, 4), ("c", 6, 7)]),
    "l.kt": ("class A {\n  fun b(x: Int): Int {\n    return 1\n  }\n}\n", [("A:b", 2, 4)]),
    "m.swift": ("struct A {\n  func b() -> Int {\n  }\n}\n", [("A:b", 2, 3)]),
    "n.zig": ("const A = struct {\n  pub fn b() void {\n  }\n};\n", [("A:b", 2, 3)]),
    "note.java": ("/* head } */\nclass A {\n  /**\n   * void fake() {\n   */ void real() {\n    s = \"/* \";\n    x(); /* } */\n  }\n"
                  "  /* open\n void no() {\n", [("A:real", 5, 8)]),
    "doc.py": ("class A:\n    def m(self):\n        class of things\n        pass\n    def n(self): pass\n", [("A:m", 2, 4), ("A:n", 5, 5)]),
    # One sample for each language of keyword blocks, paragraphs and parentheses.
    "g.rb": ("module Shop\n  class Cart\n    def add(item, n = 1)\n      return if n.zero?\n      items.each do |i|\n        while i.busy? do\n          i.wait\n"
             "        end\n      end\n      x = if n > 1 then 2 else 3 end\n    end\n\n    def self.empty? = true\n    # def no\n    def total\n      begin\n        puts \"end\"\n"
             "      rescue\n      end unless done\n    end\n  end\nend\n=begin\ndef no\n=end\ndef top; 1; end\n",
             [("Cart:add", 3, 11), ("Cart:total", 15, 20), ("top", 26, 26)]),
    "o.pas": ("unit U;\ninterface\ntype\n  TFoo = class(TBar)\n    procedure Run;\n  end;\n  TFwd = class;\nprocedure Plain(a: Integer);\nimplementation\n"
              "procedure TFoo.Run;\n  function Inner(x: Integer): Integer;\n  begin\n    Inner := x; { end }\n  end;\nvar s: string;\nbegin\n  s := 'end';\n  case a of\n"
              "    1: begin end;\n  end;\nend;\n\nprocedure Later; forward;\nprocedure Plain(a: Integer);\nBEGIN\n  (* begin\n  *) try\n  finally\n  end;\nEND;\n"
              "initialization\nbegin\nend;\nend.\n",
              [("TFoo:Run", 10, 21), ("Inner", 11, 14), ("Plain", 24, 30)]),
    "p.f90": ("module m\n  implicit none\n  type :: t\n    integer :: x\n  end type t\ncontains\n  subroutine s(a)\n    integer, intent(in) :: a ! end\n    if (a > 0) then\n"
              "      print *, 'end subroutine'\n    else if (a < 0) then\n      stop\n    end if\n    if (a == 0) return\n    do i = 1, 3\n      a = i\n    enddo\n  end subroutine s\n"
              "  pure integer function f(x) result(r)\n    integer :: x\n    r = x\n  end function\nend module m\n",
              [("s", 7, 18), ("f", 19, 22)]),
    "q.lisp": ("; (defun no ())\n(defun add (a b)\n  \"a ) string (\n  over lines\"\n  (+ a b))\n(defvar *x* #\\()\n#| (defun no () |#\n(defmacro twice (x) `(* 2 ,x))\n"
               "(defun (setf size) (v)\n  v)\n", [("add", 2, 5), ("twice", 8, 8), ("size", 9, 10)]),
    "r.cbl": ("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. DEMO.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       01 X PIC 9.\n       PROCEDURE DIVISION.\n"
              "       MAIN-PARA.\n           PERFORM WORK-PARA.\n      * A COMMENT.\n           STOP RUN.\n\n       WORK-PARA.\n           IF X = 1\n              DISPLAY 'X.'\n           END-IF.\n"
              "           EXIT.\n       LAST-PART SECTION.\n           GOBACK.\n", [("MAIN-PARA", 7, 10), ("WORK-PARA", 12, 16), ("LAST-PART", 17, 18)]),
    # Strings and comments over several lines, and what stands in them.
    "state.js": ("function a() { /* late\n } still */\n  const t = `\n}\n${x} {`;\n}\nfunction b() {\n  return '}' + \"{\";\n}\n", [("a", 1, 6), ("b", 7, 9)]),
    "state.py": ("def f():\n    \"\"\"Text\ndef no():\nat the edge\"\"\"\n    x = '''\ny\n'''\n\ndef g():\n    s = \"\"\"\n  \"\"\"\n# c\nz = 1\n",
                 [("f", 1, 7), ("g", 9, 11)]),
    "state.rs": ("fn a() {\n  let s = \"\n}\n\"; let r = r#\"}\"#;\n}\nfn b() {}\n", [("a", 1, 5), ("b", 6, 6)]),
    "state.go": ("func a() {\n\tx := `\n}\n`\n}\nfunc b() {\n}\n", [("a", 1, 5), ("b", 6, 7)]),
    "empty.py": ("", []),
    "plain.c": ("int x;\n" + "a*b*c*d*" * 4000 + ";\n" + "word " * 4000 + "\n\"" + "\\x" * 20000 + "\";\n", []),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [("p", path, text) for path, (text, _) in CASES.items()] + [("p", "g.vb", "Sub x\nEnd Sub\n")]
    out = {}
    for r in detect_functions(spark.createDataFrame(rows, "project string, path string, content string")).collect():
        out.setdefault(r["path"], []).append((r["record_no"], r["name"], r["start_line"], r["end_line"], r["status"]))
    return out


@pytest.mark.parametrize("path", list(CASES))
def test_spans(found, path):
    got = sorted(found.get(path, []))
    assert [g[1:4] for g in got] == CASES[path][1]
    assert [g[0] for g in got] == list(range(len(got)))


def test_other_languages_are_reported_not_guessed(found):
    assert found["g.vb"] == [(None, None, None, None, "uncovered")]


def test_every_listed_extension_has_a_family():
    assert set(tx.SOURCE_EXTENSIONS) == set(detect.INDENT_FAMILY) | set(detect.BRACE_FAMILY) | set(detect.KEYWORD_FAMILY)
