from __future__ import annotations

import numpy as np
import pytest

from tessella.llm.leakage import align, leaks
from tessella.llm.texwords import tex_words, word_runs

ITEM = "since nobody had seen the naïve membrane in daylight the auction was drawn from memory by a smooth clerk which is why it never reached the gradient"


def test_tex_words():
    assert tex_words(r"na\"{\i}ve na{\"\i}ve na\"ive co\"operative caf\'e Stra\ss{}e \c{c}a mem\-brane") == "naïve naïve naïve coöperative café straße ça membrane".split()
    assert tex_words(r"as \emph{seen} in \cite[p.~3]{knuth84,lam} and \ref{eq:1} % a comment") == "as seen in p 3 and a comment".split()
    assert tex_words("\\newcommand{\\x}{marks apiece}\\newcommand{\\y}[2]{#2 then #1}\n12 \\x{} \\y{a}{b c}")[-6:] == "marks apiece b c then a".split()
    assert tex_words(r"\def\loop{\loop x} \loop") and tex_words(None) == [] == tex_words("")
    assert tex_words("été") == ["été"]


def test_open_argument_drops_no_text():
    rest = " ".join(f"w{k}" for k in range(200))
    assert tex_words(r"\newcommand{\x}[1]{#1} before \x{" + rest)[-201:] == ["before", *rest.split()]
    assert tex_words(r"\newcommand{\x}[2]{#1 #2} \x{a}{b " + rest)[-202:] == ["a", "b", *rest.split()]
    assert tex_words(r"\gdef\y{marks apiece} 12 \y{} x")[-4:] == ["12", "marks", "apiece", "x"]


def brute(doc, item, n=12):
    d, i = tex_words(doc), word_runs(item.lower())
    grams = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)}
    return any(tuple(d[k : k + n]) in grams for k in range(len(d) - n + 1))


def test_found_equals_brute_force(spark):
    words = ITEM.split()
    docs = {
        1: "before " + ITEM + " after", 2: " ".join(words[3:15]), 3: " ".join(words[3:14]), 4: ITEM.upper().replace(" ", "\n% "),
        5: r"\emph{" + r"} \textbf{".join(words) + "}", 6: " ".join(w if k % 6 else "other" for k, w in enumerate(words)), 7: "", 8: None, 9: ITEM.replace("ï", r"\"{\i}"),
        10: " & ".join(words[:14]) + r" \\", 11: ITEM.replace("auction", r"\cite{key}auc\-tion"), 12: "nothing " * 50, 13: " ".join(reversed(words)),
    }
    rows = [(k, t, "x", k) for k, t in docs.items()] + [(1, docs[1], "x", 1), (None, ITEM, "x", 0)]
    corpus = spark.createDataFrame(rows, "doc_id long, text string, passage string, item_id long")
    items = spark.createDataFrame([(100, ITEM, "x"), (101, "too short", "x"), (102, None, "x"), (103, ITEM + " and more of it", "x"), (None, ITEM, "x")], "item_id long, text string, seeds string")
    wanted = {(k, i) for k, t in docs.items() if t for i, text in ((100, ITEM), (103, ITEM + " and more of it")) if brute(t, text)}
    got = leaks(corpus, items).where("longest_run >= 12").collect()
    assert {(r.doc_id, r.item_id) for r in got} == wanted and len(got) == len(wanted)
    assert {k for k, _ in wanted} == {1, 2, 4, 5, 9, 10, 11}


def test_edited_copy_is_scored(spark):
    words = ITEM.split()
    edited = " ".join(w for k, w in enumerate(words) if k % 8 != 7)
    corpus = spark.createDataFrame([(1, edited)], "doc_id long, text string")
    r = leaks(corpus, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).first()
    assert r.longest_run < 12 and r.covered > 0.8


def test_empty_tables(spark):
    corpus = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert leaks(corpus.limit(0), items).count() == 0 and leaks(corpus, items.limit(0)).count() == 0


def slow_align(a, b):
    best = 0
    grid = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            s = 2 if a[i] == b[j] else -1
            grid[i + 1, j + 1] = max(0, grid[i, j] + s, grid[i, j + 1] - 1, grid[i + 1, j] - 1)
            best = max(best, grid[i + 1, j + 1])
    return best


def test_alignment_score():
    r = np.random.default_rng(3)
    pairs = [[r.integers(2, 6, r.integers(1, 25)).astype(np.uint64) for _ in range(2)] for _ in range(40)]
    for (a, b), score, equal, run in zip(pairs, *align(*zip(*pairs))):
        assert score == slow_align(a, b) and 0 <= equal <= min(len(a), len(b))
        runs = [k for k in range(1, min(len(a), len(b)) + 1) if any((a[i : i + k] == b[j : j + k]).all() for i in range(len(a) - k + 1) for j in range(len(b) - k + 1))]
        assert run == max(runs, default=0)


def words(a, b):
    return " ".join(f"w{k}" for k in range(a, b))


@pytest.mark.parametrize("depth", [1, 7, 12, 500])
def test_chains_of_macros(depth):
    names = ["m" + "".join("abcdefghij"[int(c)] for c in str(k)) for k in range(depth)]
    chain = "".join(rf"\newcommand{{\{a}}}{{\{b}}}" for a, b in zip(names, names[1:])) + rf"\newcommand{{\{names[-1]}}}{{{words(6, 8)}}}"
    assert tex_words(rf"{chain} {words(0, 6)} \{names[0]}{{}} {words(8, 14)}")[-14:] == words(0, 14).split()


def test_cut_off_bodies_and_growth():
    body = words(0, 2000)
    assert " ".join(tex_words(r"before \m{} after \newcommand{\m}{" + body, keep=3000)).startswith(f"before {body} after")
    doubling = "".join(rf"\def\m{a}{{\m{b}\m{b}}}" for a, b in zip("abcdefghijkl", "bcdefghijklm")) + r"\def\mm{x y }"
    got = tex_words(r"a \ma b " + doubling, keep=10_000)
    assert got[:8194] == ["a", *["x", "y"] * 4096, "b"]
    endless = doubling.replace("{x y }", r"{\na\na}") + "".join(rf"\def\n{a}{{\n{b}\n{b}}}" for a, b in zip("abcdefghijklmnopqrstuvwx", "bcdefghijklmnopqrstuvwxy")) + rf"\def\ny{{{words(0, 3)} }}"
    got = tex_words(rf"{words(10, 14)} \ma {words(20, 24)} " + endless, keep=12)
    assert len(got) < 10_000
    runs = {tuple(got[k : k + 12]) for k in range(len(got))}
    cycle = words(0, 3).split() * 9
    assert {(*words(10, 14).split(), *cycle[:8]), (*cycle[1:9], *words(20, 24).split()), tuple(cycle[2:14])} <= runs


def test_many_uses_leave_other_macros_alone():
    big = r"\newcommand{\big}{" + words(0, 9000) + "}"
    two = r"\newcommand{\ina}{\inb}\newcommand{\inb}{seven eight}"
    got = tex_words(big + two + r" \big{} " * 14 + r"one \ina{} nine", keep=200)
    assert ["one", "seven", "eight", "nine"] in [got[k : k + 4] for k in range(len(got))]


def test_macros_within_macros():
    assert tex_words(r"\newcommand{\x}[1]{#1 and #1} \x{\x{a}}")[-7:] == "a and a and a and a".split()
    assert tex_words(r"\item\y \y\z \def\y{hey}")[:3] == ["hey", "hey", "hey"]
    assert tex_words(r"\def\p{\q one}\def\q{\p two} a \p b")[-3:] == ["a", "one", "b"]


def test_passage_through_a_macro_is_found(spark):
    w = ITEM.split()
    doc = r"\newcommand{\ma}{\mb}\newcommand{\mb}{" + " ".join(w[6:9]) + "} " + " ".join(w[:6]) + r" \ma{} " + " ".join(w[9:14])
    corpus = spark.createDataFrame([(1, doc), (2, doc.replace("memory", "x") + " x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (1, "quite another text " + words(0, 20)), (2, words(5, 40))], "item_id long, text string")
    got = leaks(corpus, items).where("longest_run >= 12").collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1)} and len(got) == 2
    other = spark.createDataFrame([(1, words(0, 15)), (1, "x " + words(7, 30))], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(other, items).where("longest_run >= 12").collect()} == {(1, 1), (1, 2)}


def test_long_passages_go_on_in_windows(spark):
    text = " ".join([ITEM] * 60)
    corpus = spark.createDataFrame([(1, text), (2, "go " + text)], "doc_id long, text string")
    got = {r.doc_id: r for r in leaks(corpus, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2} and all(r.longest_run == r.item_words == len(ITEM.split()) for r in got.values())


def test_alignment_has_many_tasks(spark):
    rows = [(k, " ".join(f"x{k}y{j}" for j in range(k % 7)) + " " + ITEM) for k in range(40)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    tasks = []
    from tessella.llm import leakage

    keep = leakage.cut

    def seen(df, name="cut"):
        out = keep(df, name)
        if name == "aligned":
            tasks.append(len(out.inputFiles()))
        return out

    leakage.cut = seen
    try:
        assert leaks(corpus, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 40
    finally:
        leakage.cut = keep
    assert before == "true" and tasks[0] > 1
