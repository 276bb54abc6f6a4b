"""Symbol extraction on one sample per language."""

import random
import time

import pytest
from pyspark.sql import functions as F

from codetide.functions import symbols
from codetide.functions.symbols import structure_summary, with_symbols

PYTHON = '''
import os, sys
import numpy as np
from __future__ import annotations
from . import sibling
from typing import (
    List,
    Dict as D,
)
from pkg.mod import *

# def commented_out(): pass
TEXT = "class NotAClass: pass"
DOC = """
def inside_docstring():
    nothing()
"""

class Service(Base):
    async def fetch(self, key) -> Dict:
        return self.client.get(key)

def main():
    service = Service()
    if not service.fetch(build(1)):
        print(len(x))
'''

SCRIPT = '''
import Board, { useGrid } from 'tiles';
import {
  a,
  b,
} from "./lib";
// import x from 'commented';
abstract class Hidden {}
class Panel extends Board.Frame {
    draw() {
        return paint(this.cells);
    }
    static async load(id: number): Promise<Panel> {
        for (const k of keys(id)) {
            await fetchAll(k);
        }
    }
}
function deal(seed, ...rest) {
    let deck = shuffle(seed);
    while (deck.length) { place(deck.pop()); }
}
const tally = cards => cards.reduce(plus, 0);
const later = async (x) => run(x);
const mapped = items.map(i => i + 1);
const expr = function named() { };
const made = new Thing(1);
export default class extends Panel {}
'''

JAVA = '''
package org.books;
import java.util.List;
import java.util.*;
import static org.junit.Assert.assertTrue;
import Single;

public class Ledger implements Book {
    private final Map<String, long[]> pages = new TreeMap<>();
    public Ledger(int n) {
        super(n);
    }
    public long total(String page, int from) {
        long sum = 0;
        for (long cents : pages.get(page)) {
            sum += Math.abs(round(cents, from));
        }
        return sum;
    }
    @Override
    public Map<String, List<Long>> export() {
        System.out.println(this.size());
        return copy(pages);
    }
}
interface Book {
    long total(String page, int from);
}
@interface Marker {}
'''

C = '''
#include <stdio.h>
#include "user.h"
struct node { int v; };
static int add(int a, int b)
{
    return helper(a, b);
}
char *name(void) { return 0; }
int main() {
    /* gone(); */
    printf("call(me) %d", add(1, 2));
    return sizeof(int);
}
'''

CPP = '''
#include <iostream>
template <class T> T pick(T a) { return a; }
enum class Color { Red };
class Queue {
public:
    int slot_of(const Job& job) {
        return slots.at(job.id);
    }
};
int main() {
    Queue queue;
    std::sort(a, b);
    ptr->run();
    return 0;
}
'''

GO = '''
package main
import (
    "fmt"
    h "net/http"
)
import "os"
type Meter struct {
    Volts float64
}
type Alias = Meter
func (m Meter) Read(scale int) (float64, error) {
    return math.Floor(m.Volts), nil
}
func main() {
    if check(1) {
        go work(2)
    }
    fmt.Println(NewMeter(1))
}
'''

RUST = '''
use std::collections::BTreeSet;
use rand::{thread_rng, Rng};
pub use crate::api;
use a::b as c;
struct Orbit<'a> { body: &'a str }
trait Named { fn name(&self) -> String; }
impl<'a> Orbit<'a> {
    fn around(mass: u32) -> Self { settle(mass) }
}
impl Named for Account {
    fn name(&self) -> String { self.label.to_string() }
}
impl Account { }
impl fmt::Display for Account { }
pub async fn launch(mass: u32) -> Result<Orbit, Fault> {
    let c = '"';
    Ok(Orbit::around(mass))
}
'''

EXPECTED = {
    "a/service.py": dict(
        language="python", imports=["os", "sys"], from_imports=["typing.List"],
        classes=["Service"], functions=["fetch", "main"],
        calls=["self.client.get", "Service", "service.fetch", "build", "print", "len"],
    ),
    "a/Panel.tsx": dict(
        language="typescript", imports=["tiles", "./lib"], from_imports=[], classes=["Panel"],
        functions=["draw", "load", "deal", "tally", "later"],
        calls=["paint", "keys", "fetchAll", "shuffle", "place", "deck.pop", "cards.reduce", "run", "items.map"],
    ),
    "Ledger.java": dict(
        language="java", imports=["java.util.List", "java.util", "org.junit.Assert.assertTrue"], from_imports=[],
        classes=["Ledger", "Book"], functions=["total", "export", "total"],
        calls=["pages", "Math", "round", "println", "size", "copy"],
    ),
    "x/main.c": dict(
        language="c", imports=["stdio.h", "user.h"], from_imports=[], classes=["node"],
        functions=["add", "main"], calls=["helper", "printf", "add"],
    ),
    "x/main.cpp": dict(
        language="cpp", imports=["iostream"], from_imports=[], classes=["Queue"],
        functions=["pick", "main"], calls=["slots.at", "std::sort", "ptr->run"],
    ),
    "main.go": dict(
        language="go", imports=["fmt", "net/http", "os"], from_imports=[], classes=["Meter"],
        functions=["Read", "main"], calls=["math.Floor", "check", "work", "fmt.Println", "NewMeter"],
    ),
    "main.rs": dict(
        language="rust", imports=["std::collections::BTreeSet", "crate::api"], from_imports=[],
        classes=["Orbit", "Named", "Account", "Account"], functions=["around", "name", "launch"],
        calls=["settle", "self.label.to_string", "Ok", "Orbit::around"],
    ),
}
SOURCES = {
    "a/service.py": PYTHON, "a/Panel.tsx": SCRIPT, "Ledger.java": JAVA, "x/main.c": C,
    "x/main.cpp": CPP, "main.go": GO, "main.rs": RUST,
}


@pytest.fixture(scope="module")
def extracted(spark):
    files = spark.createDataFrame(list(SOURCES.items()) + [("README.md", "def no(): pass")], "file_path string, content string")
    rows = with_symbols(files).withColumn("summary", structure_summary()).collect()
    return {r.file_path: r for r in rows}


@pytest.mark.parametrize("path", list(EXPECTED))
def test_symbols(extracted, path):
    row, want = extracted[path], EXPECTED[path]
    got = dict(
        language=row.language, imports=row.imports, from_imports=[f"{e.module}.{e.name}" for e in row.from_imports],
        classes=row.classes, functions=row.functions, calls=row.calls,
    )
    assert got == want


def test_unknown_type_is_empty(extracted):
    row = extracted["README.md"]
    assert row.language is None and row.functions == [] and row.calls == []
    assert row.summary == "Language: unknown"


def test_structure_summary(spark):
    code = "import os\nfrom typing import List\n\nclass Basket:\n    pass\n\ndef fill():\n    run(1)\n    run(2)\n"
    df = spark.createDataFrame([("test.py", code)], "file_path string, content string")
    assert with_symbols(df).select(structure_summary().alias("s")).first().s == (
        "Language: python\nImports: os\nFrom Imports: typing.List\nClasses/Types: Basket\n"
        "Functions: fill\nCalls: run"
    )


def test_long_literals_do_not_overflow(spark):
    long_string = 'x = "' + r"\n" * 60000 + '"\n' + "y = (" + "(a)," * 30000 + ")\ndef tail():\n    pass\n"
    df = spark.createDataFrame([("big.py", long_string), ("big.js", long_string)], "file_path string, content string")
    rows = {r.file_path: r.functions for r in with_symbols(df).select("file_path", "functions").collect()}
    assert rows["big.py"] == ["tail"]


def test_call_scans_find_what_the_patterns_find(spark):
    """The patterns for a backtracking matcher against those that any engine runs, on random text."""
    rng = random.Random(5)
    parts = ["a", "Z", "_", "$", "1", "\u0301", "é", "\U0001d49c", " ", "\t", "\n", "(", ")", "*", "&", ">", "]", ".", "?.", "::", "->", "{", "=", ";",
             "func", "func ", "async ", "return ", "x y(", "f(a) {"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(1, 40))),) for _ in range(5000)]
    texts = spark.createDataFrame(rows, "t string")
    for key, scan in symbols.CALL_SCANS.items():
        found = lambda pattern: F.regexp_extract_all("t", F.lit("(?d)" + pattern), F.lit(0))
        assert texts.where(found(scan) != found(symbols.PATTERNS[key])).collect() == []
    for family in symbols.LEXICAL:
        blank = lambda pattern: F.regexp_replace(F.translate("t", "Z1*&", "\"'/#"), pattern, "<$1>")
        assert texts.where(blank(symbols._scan_pattern(family)) != blank(symbols.strip_patterns(family))).collect() == []


def test_calls_beside_a_long_name(spark):
    """A name of any length is read a bounded number of times, not once per letter."""
    source = spark.createDataFrame([("r", "a.py", "a" * 150_000 + "\nfoo(1)\n")], "repo string, file_path string, content string")
    start = time.perf_counter()
    assert symbols.with_symbols(source).first().calls == ["foo"]
    assert time.perf_counter() - start < 15
