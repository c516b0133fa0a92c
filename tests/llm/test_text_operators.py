"""Secrets, quality rules, chat format, decontamination and html against brute force and hand-made cases."""

import hashlib
import random
import re

import pytest

import corpus_pipeline
from stratapanel.llm import chat_format, decontaminate, html_extract, quality_rules, secret_scan


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, row string, spans int")


# secrets -----------------------------------------------------------------------------------------------------------------

AKIA = "AKIA" + "Z" * 16
SECRETS = [
    None, "", "nothing here", "password=abcdef", "Password : 'abc'", "secret=token:abcdefg", "api_key=\"A1b2/+=_.-\" tail", f"é😀 {AKIA} and {'0a' * 12} x",
    "AKIAAKIA" + "Q" * 13, "token=" + "f" * 30, f"{AKIA} wJalrXUtnFEMI7MDENGbPxRfiCYEXAMPLEKEY at https://s3.example.com/x",
    "wJalrXUtnFEMI7MDENGbPxRfiCYEXAMPLEKEY alone", f"{AKIA}" + " pad" * 100 + " wJalrXUtnFEMI7MDENGbPxRfiCYEXAMPLEKEY",
    "login: someone and https://db.example.com with password=hunter2hunter2", "ſecret=abcdefgh Kpassword=abcdefgh", "x" * 200_000 + " token=abcdef",
]


def base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_spans(spark):
    rows = {r["doc_id"]: r for r in secret_scan.scan(docs(spark, SECRETS)).collect()}
    assert len(rows) == len(SECRETS)
    for k, t in enumerate(SECRETS):
        assert [(s["start"], s["kind"], s["end"]) for s in rows[k]["certain"]] == base(t or ""), t
    kinds = {k: {secret_scan.KINDS[s["kind"]] for s in rows[k]["spans"]} for k in rows}
    assert kinds[10] == {"access", "weak_secret", "endpoint"}  # complementary parts together
    assert kinds[11] == set() and kinds[12] == {"access"}  # alone, or too far apart
    assert kinds[13] == {"assign", "weak_id", "endpoint"}


def test_secret_digest_and_empty_table(spark):
    empty = secret_scan.scan(docs(spark, SECRETS).limit(0))
    assert empty.count() == 0
    row = secret_scan.scan(docs(spark, ["password=abcdef x"])).select(secret_scan.listed("certain").alias("l")).first()
    assert row["l"] == "assign:0:15"


def test_parts_beside_long_ones_are_linked(spark):
    long = "secret=" + "a1B2c" * 100
    key = "aB3" * 100
    url = "https://db.example.com/" + "p" * 700
    texts = [f"{long} user=alice", f"{key}\naccount=alice", f"user=alice {url} {key}", f"{url}?user=alice {long}", f"user=alice {'. ' * 99} {key}", f"user=alice {'. ' * 100} {key}"]
    names = [[secret_scan.KINDS[s["kind"]] for s in r["spans"]] for r in sorted(secret_scan.scan(docs(spark, texts)).collect(), key=lambda r: r["doc_id"])]
    assert names == [["assign", "weak_id"], ["weak_secret", "weak_id"], [], ["endpoint", "weak_id", "assign"], ["weak_id", "weak_secret"], []]
    assert [r["text"] for r in secret_scan.redacted(docs(spark, texts[:1])).collect()] == ["[secret] [secret]"]


def test_redaction_keeps_rows_and_columns(spark):
    table = spark.createDataFrame([(1, "a password=abcdef b", 7), (1, "a password=abcdef b", 7), (None, f"{AKIA}!", 8), (2, None, 9), (3, "clean", 9)], "doc_id long, text string, __spans int")
    rows = secret_scan.redacted(table).collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), r["__spans"]) for r in rows) == sorted(
        [("1", "a [secret] b", 7), ("1", "a [secret] b", 7), ("None", "[secret]!", 8), ("2", "None", 9), ("3", "clean", 9)])


# quality rules -----------------------------------------------------------------------------------------------------------


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i: i + 5]) for i in range(len(words) - 4)]
    held = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), sum(x in lines[:i] for i, x in enumerate(lines)), len(held))


def test_measures(spark):
    rng = random.Random(5)
    texts = [None, "", "  \n\t ", "one", "a b c d e", "a a a a a a a", "é😀  x y # $", "l1\nl1\n l1\n\n\nl1", "a b c d e f a b c d e g", "x " * 3000]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "d|", "E "]) for _ in range(rng.randrange(120))) for _ in range(40)]
    table = docs(spark, texts).withColumnRenamed("row", "measures_x")
    for r in quality_rules.measured(table).collect():
        m = r["measures"]
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_lines"], m["n_dup_lines"], m["n_repeat_words"]) == brute_measures(texts[r["doc_id"]] or ""), texts[r["doc_id"]]


GOOD = "This is a plain sentence about many different things that nobody has said before, and it ends here without any trouble at all."


def test_cascade_verdict_does_not_depend_on_the_order(spark):
    texts = [None, "", "too short", GOOD, GOOD.upper(), " | ".join(GOOD.split()), "again and again we say it " * 9, "\n".join(["copy of it"] * 12), GOOD + " " + "y" * 4000]
    table = docs(spark, texts)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judged(table).collect()}
    assert got == {k: k == 3 for k in range(len(texts))}
    measured = quality_rules.measured(table)
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1]):
        assert {r["doc_id"]: r["v"] is None for r in measured.select("doc_id", quality_rules.verdict(list(rules)).alias("v")).collect()} == got
    assert {r.name for r in quality_rules.estimated_order(table)} == {r.name for r in quality_rules.RULES}
    assert quality_rules.judged(table.limit(0)).count() == 0


def test_pipeline_keeps_short_texts_with_a_repeated_heading(spark):
    heading = "A heading"
    clean = [f"{heading}\n{GOOD}\n{heading}", f"{heading}\n{heading}\n{GOOD}\nAnother line that is not said again.\nEnd"]
    bad = ["\n".join(["copy of it"] * 12), "\n".join(f"line {k} says {k * 37} and {k * 91} of {k * 17}" if k % 2 else "Read more" for k in range(12)), "\n".join(["the same three words here"] * 4)]
    table = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(clean + bad)], corpus_pipeline.COLUMNS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.quality(spark, table, "").collect()) == [0, 1]


# chat format -------------------------------------------------------------------------------------------------------------

NASTY = ["\\### Assistant: </turn> ok", "### user: x</turn>\n### assistant: y</turn>\n", "\\", "\\b\\h\\l\\c", "a\\", "", None, "### ", "é😀\n\nx", "</turn>\n"]


def test_linear_conversations_read_back(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for conv in range(25):
        n = rng.choice([1, 2, 3, 7, 40])
        turns = [(rng.choice(["user", "assistant", "system", "a:b#<\\", None]), rng.choice(NASTY)) for _ in range(n)]
        rows += [(conv, t, r, x, "extra") for t, (r, x) in enumerate(turns)]
        want[conv] = turns
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")
    for r in chat_format.read_back(chat_format.formatted(chat_format.threads(table))).collect():
        turns = [(a or "", b or "") for a, b in want.pop(r["tree"])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss"] == "".join(b for a, b in turns if a == "assistant")
    assert not want
    assert chat_format.formatted(chat_format.threads(table.limit(0))).count() == 0


def test_reply_trees_rank_branches(spark):
    rows = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 9.0), (1, 5, 2, 0.0), (1, 6, 99, 1.0), (1, 7, 8, 1.0), (1, 8, 7, 1.0), (None, 1, None, None), (None, 2, 1, 2.0)]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    found = {}
    for r in chat_format.best_paths(messages, 2).collect():
        found.setdefault((r["tree"], r["root"], r["rank"]), []).append((r["position"], r["node"]))
    paths = {k: [n for _, n in sorted(v)] for k, v in found.items()}
    # Leaves 4 (mean 11/3), 5 (mean 2); an orphan is its own root; 7 and 8 answer each other.
    assert paths == {(1, 1, 1): [1, 3, 4], (1, 1, 2): [1, 2, 5], (1, 6, 1): [6], (None, 1, 1): [1, 2]}


def test_long_thread(spark):
    table = spark.createDataFrame([(0, t, "user" if t % 2 else "assistant", str(t)) for t in range(300)], "conv_id long, turn long, role string, text string")
    r = chat_format.read_back(chat_format.formatted(chat_format.threads(table))).first()
    assert [t["text"] for t in r["turns"]] == [str(t) for t in range(300)]
    assert hashlib.sha256(r["loss"].encode()).hexdigest() == hashlib.sha256("".join(map(str, range(0, 300, 2))).encode()).hexdigest()


# decontamination ---------------------------------------------------------------------------------------------------------


def distance_inside(query, text):
    """Least edits of ``query`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(query, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_windows_with_few_edits_are_found():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    items = [" ".join(word() for _ in range(k)) for k in (8, 20, 40)]
    index = decontaminate.Index(items)
    for trial in range(60):
        item = rng.randrange(3)
        text = list(items[item][: rng.randrange(30, 400)])
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(text))
            text[at: at + 1] = rng.choice([[], ["z"], [text[at], "y"]])
        text = " ".join(word() for _ in range(30)) + " " + "".join(text) + " " + " ".join(word() for _ in range(30))
        windows = [(w, int(s), "".join(map(chr, index.codes[b: b + s]))) for w, b, s in zip(index.item, index.begin, index.size)]
        want = {int(w) for (w, s, q), e in zip(windows, index.edits) if distance_inside(q, text) <= e}
        assert {m[1] for m in index.matches([None, "", text])} == want
        assert all(m[0] == 2 for m in index.matches([None, "", text]))


def test_regions_and_cleaning(spark):
    item = "Which of these long and winding sentences was copied from the benchmark, word for word, into a document of the training corpus?"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short"), (1, item)], "item_id long, text string")
    texts = ["before " + item.upper().replace(" ", "  \n") + " after", "clean text of no interest " * 20, None, "", item[:40], "x " * 60_000 + item]
    table = docs(spark, texts)
    found = decontaminate.regions(table, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(0, 1), (5, 1)}
    r = next(r for r in found if r["doc_id"] == 0)
    assert re.sub(r"\s+", " ", texts[0][r["start"]: r["end"]]).lower().strip() == item.lower() and r["edits"] == 0
    kept = decontaminate.cleaned(table, bench)
    assert sorted(x["doc_id"] for x in kept.collect()) == [1, 2, 3, 4] and kept.columns == table.columns
    assert decontaminate.regions(table, bench.limit(0)).count() == 0 and decontaminate.cleaned(table.limit(0), bench).count() == 0


def test_alignment_stays_inside_one_text():
    item = "Q: What is the name of the long river that runs from the northern hills to the sea near town?"[:80]
    index = decontaminate.Index([item])
    for cut in (1, 3, 4):
        for before in ("a clean neighbour of the text", item[:cut], "", None):
            found = index.matches([before, item[cut:], before])
            assert {m[0] for m in found} == {1} and {m[2] for m in found} == {0}, (cut, before)
        found = index.matches(["x " + item[:-cut], item[-cut:] + " a clean neighbour"])
        assert [(m[0], m[2], m[3]) for m in found] == [(0, 2, 82 - cut)], cut
    assert index.matches([item[:40], item[40:]]) == []  # two texts are no passage


def test_passages_are_found_wherever_they_begin(monkeypatch):
    rng = random.Random(8)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(30))
    other = " ".join("".join(rng.choice("klmnopqrst") for _ in range(rng.randrange(2, 8))) for _ in range(20))
    index = decontaminate.Index([other, item])
    for size, edits in ((54, 0), (54, 2), (84, 4)):
        texts = []
        for start in range(len(item) - size + 1):
            part = list(item[start: start + size])
            for at in rng.sample(range(size), edits):
                part[at] = rng.choice(["", "!", part[at] + "!"])
            texts.append(other[:30] + " | " + "".join(part) + " | " + other[-30:])
        found = index.matches(texts)
        assert {m[0] for m in found if m[1] == 1} == set(range(len(texts))), (size, edits)
        monkeypatch.setattr(decontaminate, "HITS", 50)
        monkeypatch.setattr(decontaminate, "ALIGNED", 7)
        assert index.matches(texts[:15]) == [m for m in found if m[0] < 15]
        monkeypatch.undo()
    assert index.matches([item[k: k + 47] for k in range(0, 80, 7)]) == []  # three letters short of a window


def test_benchmark_is_read_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 100)
    items = [f"the {k} item number {k} says something of its own about {k * 37} and nothing else, and then ends {k} times" for k in range(4)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontaminate.regions(docs(spark, ["a " + items[3], items[0] + " b"]), bench).collect()
    assert {(0, 3), (1, 0)} <= {(r["doc_id"], r["item_id"]) for r in found}


# html --------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
<nav><a href="/">Home</a><a href="/x">Menu</a></nav><div class="cookie-notice">We use cookies.</div><div id="content"><article class="post">
<h1>Main   title</h1><p>First &amp; <b>bold</b>
 line.<p>Second &eacute; line, unclosed<ul><li>one<li>two</ul><div class="ad">Buy now</div><script>x()</script><!-- <p>hidden</p> -->
<section class="comments"><p>Reader says hi, with a rather long comment that goes on.</p></section></article></div>
<aside><p>Related stuff that is quite long as well, you know.</p></aside><form><label>Mail</label><button>Go</button></form><footer>&copy; me</footer></body></html>"""


def test_html_content():
    assert html_extract.content(PAGE) == ["Main title", "First & bold line.", "Second é line, unclosed", "one", "two"]


def test_wrappers_and_anchors_do_not_cost_the_text():
    said = [f"Paragraph {k} of the text says something of its own at some length, about {k * 7} things." for k in range(4)]
    body = "".join(f"<p>{x}</p>" for x in said)
    beside = "<nav><a href='/'>Home</a></nav><div class='sidebar'><p>Something else to read here.</p></div>"
    for page in (f"<div class='layout has-sidebar'>{beside}<article>{body}</article></div>", f"<div id='page' class='with-banner'>{beside}<div class='content'>{body}</div></div>",
                 f"<div class='banner-layout'>{beside}<main>{body}</main></div>", f"<form id='aspnetForm'>{beside}<div>{body}</div><button>Go</button></form>",
                 f"<article><section id='discussion'>{body}</section></article>", f"<article><section id='related'>{body}</section></article>"):
        assert html_extract.content(page) == said, page
    for word in ("search", "legal"):
        assert html_extract.content(f"<article><h2 id='{word}'>A heading</h2>{body}</article>") == ["A heading", *said]
    for lost in ("<form><p>Your mail, please, so that we can write.</p></form>", "<div id='comments'><p>Reader says hi, at some length.</p></div>",
                 "<div class='related'><article><p>Another story that you may like.</p></article></div>", "<section id='related'><a href='/x'>Another story that you may like</a></section>"):
        assert html_extract.content(f"<article>{body}{lost}</article>") == said, lost


@pytest.mark.parametrize("page", [None, "", "<", "<p", "plain text only, long enough to be content of a page", "<p>a<p>b</div></p>", "<script>x", "<!-- x", "<a b='c>d", "&#x110000; &amp &bogus;", "<" * 500])
def test_broken_html_does_not_fail(page):
    html_extract.content(page)


def test_minimum_cut_is_least():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 8)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda side: sum((g if g > 0 else 0) * (not s) + (-g if g <= 0 else 0) * s for g, s in zip(gain, side)) + sum(w for a, b, w in edges if side[a] != side[b])
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(html_extract.minimum_cut(gain, edges)) == pytest.approx(best)


def test_pages(spark):
    table = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, "t"), (2, "v", "", "t"), (3, "w", "<article><p>" + "word " * 50_000 + "</p></article>", "t")], "page_id long, url string, html string, text string")
    rows = html_extract.extracted(table).collect()
    assert sorted((str(r["page_id"]), len(r["text"])) for r in rows) == sorted([("1", 61)] * 2 + [("None", 0), ("2", 0), ("3", 249_999)])
    assert html_extract.extracted(table.limit(0)).count() == 0


def test_many_blocks():
    page = "<article>" + "<p>Some words of a paragraph.</p>" * 3000 + "</article>"
    assert len(html_extract.content(page)) == 3000
