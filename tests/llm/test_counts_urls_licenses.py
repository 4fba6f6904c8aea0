from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from frameloom.llm import license_scan as ls
from frameloom.llm import token_counts as tc
from frameloom.llm import url_filter as uf

from .support import awkward, awkward_rows, empty, rows_of


# Token counts


def counted(spark):
    rows = [("a", "en", 5), ("a", "en", 7), ("b", None, 3), (None, "fr", 2), ("b", None, 3)]
    return spark.createDataFrame(rows, "source string, lang string, n long")


def test_batches_add_up_and_are_applied_once(spark, tmp_path):
    ledger = tc.Ledger(spark, str(tmp_path / "ledger"))
    docs = counted(spark).withColumn("tokens", F.lit("clash"))
    assert ledger.commit("1", tc.change(docs, 1, "v1", F.col("n")))
    assert not ledger.commit("1", tc.change(docs, 1, "v1", F.col("n")))
    assert rows_of(ledger.totals(), "source", "lang", "version", "docs", "tokens") == sorted([("a", "en", "v1", 2, 12), ("b", None, "v1", 2, 6), (None, "fr", "v1", 1, 2)], key=repr)
    gone = docs.where("source = 'b'")
    assert ledger.commit("2", tc.change(gone, -1, "v1", F.col("n")))
    assert ledger.commit("3", tc.revision(docs.where("source = 'a'"), ("v1", F.col("n")), ("v2", F.col("n") * 2)))
    assert rows_of(ledger.totals(), "source", "lang", "version", "docs", "tokens") == sorted([("a", "en", "v1", 0, 0), ("a", "en", "v2", 2, 24), ("b", None, "v1", 0, 0), (None, "fr", "v1", 1, 2)], key=repr)


def test_a_batch_that_broke_off_counts_nowhere_and_is_written_again(spark, tmp_path, monkeypatch):
    ledger = tc.Ledger(spark, str(tmp_path / "ledger"))
    changes = tc.change(counted(spark), 1, "v1", F.col("n"))
    ledger.commit("1", changes)
    # An attempt that wrote all of its rows but was not renamed, and one that was cut off within them.
    changes.groupBy(*tc.GROUP).agg(F.sum("sign").alias("docs"), F.sum("tokens").alias("tokens"), F.count("*").alias("inserted"), F.lit(0).alias("deleted")).write.parquet(f"{ledger.path}/_attempt-x")
    (tmp_path / "ledger" / "_attempt-y").mkdir()
    (tmp_path / "ledger" / "_attempt-y" / "part-0.parquet").write_bytes(b"half a")
    assert not ledger.committed("2")
    assert tuple(ledger.totals().agg(F.sum("docs"), F.sum("tokens")).first()) == (5, 20)
    assert ledger.commit("2", changes)
    assert tuple(ledger.totals().agg(F.sum("docs"), F.sum("tokens")).first()) == (10, 40)


def test_of_two_writers_of_a_batch_one_wins(spark, tmp_path, monkeypatch):
    ledger, other = (tc.Ledger(spark, str(tmp_path / "ledger")) for _ in range(2))
    changes = tc.change(counted(spark), 1, "v1", F.col("n"))
    answers = iter([False])
    monkeypatch.setattr(ledger, "committed", lambda batch: next(answers))  # asked before the other one has ended
    assert other.commit("1", changes)
    assert not ledger.commit("1", changes)
    assert ledger.totals().agg(F.sum("docs")).first()[0] == 5
    assert not list((tmp_path / "ledger").glob("_attempt*"))


def test_no_batch_has_no_totals(spark, tmp_path):
    assert tc.Ledger(spark, str(tmp_path / "none")).totals().count() == 0


def test_an_empty_batch_is_committed(spark, tmp_path):
    ledger = tc.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.commit("0", tc.change(counted(spark).limit(0), 1, "v1", F.col("n")))
    assert not ledger.commit("0", tc.change(counted(spark), 1, "v1", F.col("n")))
    assert ledger.totals().count() == 0


def test_encoded_sizes_equal_the_library(spark):
    from frameloom.llm import bpe

    tok = bpe.Encoder(bpe.default_tokenizer())
    docs = awkward(spark).withColumn("encoded", F.lit("clash"))
    got = tc.encoded_sizes(docs, bpe.default_tokenizer(), "encoded")
    assert "text" not in got.columns
    want = sorted(((i, len(tok.lib.encode(text or "", add_special_tokens=False).ids)) for i, text, *_ in awkward_rows()), key=repr)
    assert rows_of(got, "doc_id", "encoded") == want


def test_query_equals_brute_force(spark, smoke_dir):
    from frameloom.llm import bpe

    from .support import words

    tok = bpe.Encoder(bpe.default_tokenizer())
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{smoke_dir}/labels.parquet").where("toxic = 1").collect()}
    want: dict = {}
    for r in spark.read.parquet(f"{smoke_dir}/documents.parquet").collect():
        n = len(words(r["text"]))
        changes = [(tc.OLD, n, 1), (tc.OLD, n, -1)]
        if r["doc_id"] not in toxic:
            changes.append((tc.NEW, len(tok.lib.encode(r["text"] or "", add_special_tokens=False).ids), 1))
        for version, tokens, sign in changes:
            own = want.setdefault((r["source"], r["lang"], version), [0, 0, 0, 0])
            for k, x in enumerate((sign, sign * tokens, sign > 0, sign < 0)):
                own[k] += x
    got = rows_of(tc.op4_token_counts(spark, smoke_dir), *tc.GROUP, "docs", "tokens", "inserted", "deleted")
    assert got == sorted(((*k, *v) for k, v in want.items()), key=repr)


# URL filters


def brute_glob(glob: str, text: str) -> bool:
    return re.fullmatch("".join({"**": "(?s:.)*", "*": "[^/]*", "?": "(?s:.)"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|\*|\?|[^*?]", glob)), text) is not None


def test_automaton_equals_regular_expressions():
    rnd = random.Random(5)
    globs = ["".join(rnd.choice(["a", "b", "/", "*", "**", "?", "."]) for _ in range(rnd.randrange(0, 9))) for _ in range(60)]
    globs = [re.sub(r"\*{2,}", "**", g) for g in globs]
    texts = ["".join(rnd.choice("ab/.") for _ in range(rnd.randrange(0, 14))) for _ in range(300)] + ["a" * 5000]
    automaton = uf.Automaton(globs)
    assert automaton.match.shape[1] > 2  # several words
    fits = automaton.fits([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for k, g in enumerate(globs):
            assert fits[i, k] == brute_glob(g, t), (g, t)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"),
        ("no mark", "", "", None, "allow"),
        ("http://", "", "", None, "allow"),
        ("http://COM/en/x", "com", "/en/x", "com/en/", "block"),
        ("http://a.Example.com/en/71?q", "a.example.com", "/en/71", "example.com/en/7", "allow"),
        ("http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        ("http://xexample.com/en/7", "xexample.com", "/en/7", "com/en/", "block"),
        ("http://example.net/de/1#f", "example.net", "/de/1", "net/de/", "allow"),
        ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
        ("http://z.org?x=/es/", "z.org", "", None, "allow"),
        ("http://z.org/EN/y.com/en/", "z.org", "/EN/y.com/en/", None, "allow"),
        ("ftp://cheap-pills.example.com/fr/1", "cheap-pills.example.com", "/fr/1", None, "block"),
        ("http://a.edu/ads/x", "a.edu", "/ads/x", None, "allow"),
        ("http://é.org/es/", "é.org", "/es/", "org/es/", "block"),
        ("http://a/b://c.com/en/", "a", "/b://c.com/en/", None, "allow"),
    ],
)
def test_contract_rules(url, host, path, rule, verdict):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    row = uf.judge(spark.createDataFrame([(1, url, "clash")], "page_id long, url string, rule string")).first()
    assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)


def test_hosts_are_blocked_with_and_without_a_path(spark):
    hosts = ["x.spam.net", "spam.net", "pills.org", "casino.example", "a.poker.com", "porn.net", "xxx.org", "torrent.net", "malware.com", "phish.net", "a.ads.net", "adserver1.net"]
    urls = [(h, f"http://{h}{rest}") for h in hosts for rest in ("/", "", "?x=1", "#f")]
    got = uf.judge(spark.createDataFrame(urls, "name string, url string"))
    assert [r["url"] for r in got.where("verdict <> 'block'").collect()] == []
    kept = [(u,) for u in ("http://spam.edu", "http://a.net/spam", "http://a.net?spam", "http://a.net#casino")]
    assert {r["verdict"] for r in uf.judge(spark.createDataFrame(kept, "url string")).collect()} == {"allow"}
    assert {r["pattern"] for r in uf.judge(spark.createDataFrame([("http://casino.example?x=1",)], "url string")).collect()} == {"*.*casino*"}


def test_rules_may_come_from_a_table(spark):
    table = spark.createDataFrame([("*.bad/**", "block", 1), ("**/ok*", "allow", 5), ("*.bad/**", "block", 1)], "glob string, verdict string, rank int")
    pages = spark.createDataFrame([("http://x.bad/a",), ("http://x.bad/ok",), ("http://good/a",)], "url string")
    rules = uf.rules_of(table)
    assert len(rules) == 2
    assert [(r["verdict"], r["pattern"]) for r in uf.judge(pages, rules).collect()] == [("block", "*.bad/**"), ("allow", "**/ok*"), ("allow", None)]
    with pytest.raises(ValueError):
        uf.rules_of(table.withColumn("verdict", F.lit("perhaps")))


def test_thousands_of_rules(spark, monkeypatch):
    """Every rule counts, and URLs are walked in slices whose states stay small."""
    table = spark.range(12_000).select(F.concat(F.lit("*.site"), "id", F.lit(".example/**")).alias("glob"), F.lit("block").alias("verdict"), F.lit(1).alias("rank"))
    rules = uf.rules_of(table)
    assert len(rules) == 12_000
    monkeypatch.setattr(uf, "SLICE_WORDS", 40_000)
    automaton = uf.Automaton([r.glob for r in rules])
    seen, walk = [], automaton._fits
    monkeypatch.setattr(automaton, "_fits", lambda part: seen.append(len(part)) or walk(part))
    hit = [b".site11999.example/a", b".www.site0.example/", b".site12000.example/a", b".site5.example"] * 20
    assert [rules[k].glob if k >= 0 else None for k in automaton.first(hit)] == ["*.site11999.example/**", "*.site0.example/**", None, None] * 20
    assert max(seen) * automaton.match.shape[1] <= 40_000 and sum(seen) == 80


def test_query_and_sql_agree_on_hosts_without_a_path(spark, tmp_path):
    import duckdb

    urls = [f"http://{h}{rest}" for h in ("casino.com", "my-poker.net", "ads.example", "x.adserver", "plain.example", "uni.edu", "a.com") for rest in ("", "/", "?x", "#y", "/en/1", "/ads/x")] + [None, "", "no scheme", "http://", "HTTP://CASINO.COM"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((tuple(r) for r in uf.op5_url_filter(spark, str(tmp_path)).collect()), key=repr)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(db.sql(uf.OP5_SQL).fetchall(), key=repr)
    assert {r[0] for r in got if r[4] == "block"} >= {urls.index("http://casino.com"), urls.index("http://my-poker.net?x")}


def test_no_rules_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/")] * 2, "page_id long, url string")
    assert [r["verdict"] for r in uf.judge(pages, ()).collect()] == ["allow", "allow"]
    assert uf.judge(pages.limit(0)).count() == 0


# License scans


def brute_base(text: str | None) -> tuple:
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for n in ls.BASE:
        phrase = n.words.split()
        for k in range(len(own) - len(phrase) + 1):
            if own[k : k + len(phrase)] == phrase:
                places.append(k)
                labels.add(n.label)
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def license_rows(seed: int = 6) -> list[tuple]:
    rnd = random.Random(seed)
    bits = ["Under the MIT License", "apache license, version 2", "CC-BY-NC", "under", "the", "mit", "license", "cc", "by", "nc", "cc by nc by nc", "Ünder", "\n", "é"]
    return [(k, " ".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 60))), "en", "s", 1) for k in range(150)]


def test_base_places_equal_brute_force(spark):
    rows = awkward_rows() + license_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    got = ls.scan(docs)
    for r in got.collect():
        want = brute_base(r["text"])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want, r["text"]
        assert set(want[4].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) >= bool(want[1])
    assert ls.scan(empty(spark)).count() == 0


def test_edits_are_found_and_bounded(spark):
    texts = ["Released undr the MIT Licence today", "this is under the mti lycense ok", "GNU Generel Publik License", "the gnu license of the public", "xunder the mit licensex", "All Rights Resrved"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["n_base"], r["spans"]) for r in ls.scan(docs).collect()}
    assert got[0] == ("mit", 0, "mit:1-4:2")
    assert got[1][0] == "" and got[3][0] == ""
    assert got[2][0] == "gpl" and got[2][2] == "gpl:0-3:2"
    assert got[5] == ("all-rights-reserved", 0, "all-rights-reserved:0-2:1")


NEAR_MISSES = [
    "under the mpl license", "under the bit license", "under the mitre license", "undr the mpl license", "apache license version 1", "apache license version 1.1", "apache license version 1.2", "apache license version 12", "apache license version 3",
    "the general public license", "any general public license", "bozilla public license", "nozilla public license", "cc0 2 0 universal", "cc0 1 1 universal",
]


def test_other_licenses_are_no_edits():
    scanner = ls.Scanner((*ls.BASE, *ls.MORE))
    for text in NEAR_MISSES:
        assert scanner.spans(b" this is %s or so " % b" ".join(ls.reduced(text.encode()))) == [], text
    for text, label, edits in (("under the mpl license or under the mit license", "mit", 0), ("apache license version 1 1 and apache licence version2", "apache-2", 2), ("undr the mit licnse", "mit", 2), ("gnu leser general publik license", "lgpl", 2), ("mozila public license", "mpl", 1)):
        assert [(scanner.notices[k].label, n) for k, _, _, n in scanner.spans(b" this is %s or so " % text.encode())] == [(label, edits)], text


def locks(notice: ls.Notice) -> list[tuple[str, bool, bool]]:
    """Of each letter of a notice: how it is held (free, word: glued to the letter before, ends), blank before, blank behind."""
    out: list[tuple[str, bool, bool]] = []
    for word in notice.words.split():
        if out:
            out.append(("free", False, False))
        for k in range(len(word)):
            first, last = k == 0, k == len(word) - 1
            if word in notice.tell:
                out.append(("held" if first else "glued", first, last))
            elif word in notice.ends and (first or last):
                out.append(("held", first, last))
            else:
                out.append(("free", False, False))
    return out


def distance(notice: ls.Notice, text: str, begin: int, end: int) -> float:
    """Edit distance of a notice and text[begin:end], whose held letters stay."""
    held, letters, span = locks(notice), notice.words, text[begin:end]
    digits = any(w.isdigit() for w in notice.tell)
    inf = float("inf")
    row = [inf if digits and any(c.isdigit() for c in span[:j]) else float(j) for j in range(len(span) + 1)]
    for i, (how, before, behind) in enumerate(held):
        new = [inf if how != "free" else row[0] + 1]
        for j, c in enumerate(span):
            at = begin + j
            plain = letters[i].isdigit() and letters[i] == c and not (text[at - 1].isdigit() or text[at + 1].isdigit())
            fits = letters[i] == c and (plain or letters[i].isdigit() is False and (not before or text[at - 1] == " ") and (not behind or text[at + 1] == " ") or (how == "free" and letters[i] == c))
            free = how == "free" and not (digits and c.isdigit())
            best = row[j] if fits else row[j] + 1 if free else inf
            if how == "free":
                best = min(best, row[j + 1] + 1)
            follows = i + 1 < len(held) and held[i + 1][0] == "glued"
            if not follows and not (digits and c.isdigit()):
                best = min(best, new[j] + 1)
            new.append(best)
        row = new
    return row[-1]


def test_finds_equal_brute_force_by_edit_distance():
    """All spans of words against all notices by plain dynamic programming: the same labels, and no find is closer than it says."""
    rnd = random.Random(21)
    notices = [n for n in (*ls.BASE, *ls.MORE) if len(n.words) < 30]
    scanner = ls.Scanner(notices)
    seen = 0
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 3)):
            letters = list(rnd.choice(notices).words)
            for _ in range(rnd.randint(0, 4)):
                at = rnd.randrange(len(letters))
                letters[at : at + rnd.randint(0, 1)] = rnd.choice(["x", "2", "", " ", "e"])
            parts += ["".join(letters), rnd.choice(["and", "mit", "2", "the gnu", ""])]
        words = " ".join(parts).split()
        text = f" {' '.join(words)} "
        at = [k + 1 for k, c in enumerate(text[:-1]) if c == " "]
        ends = [k for k, c in enumerate(text) if c == " "][1:]
        want: dict = {}
        for k, n in enumerate(notices):
            for b in at:
                for e in ends:
                    if abs(e - b - len(n.words)) <= n.edits:
                        d = distance(n, text, b, e)
                        if d <= n.edits:
                            want[k, b, e] = d
        got = scanner.finds(text.encode())
        assert {k for k, *_ in got} == {k for k, *_ in want}, text
        for k, b, e, n in got:
            assert want[k, b, e] <= n <= notices[k].edits, (text, notices[k].words)
        # The closest of what claims the same words stays.
        left = scanner.spans(text.encode())
        for k, b, e, n in set(got) - set(left):
            assert any(x < e and b < y and m <= n and notices[o].label != notices[k].label for o, x, y, m in left)
        seen += len(got)
    assert seen > 60


def test_no_match_ends_inside_a_word():
    scanner = ls.Scanner((ls.Notice("arr", "all rights reserved", 2),))
    assert scanner.spans(b" all rights reservedxyzxyzxyz and so ") == []
    assert [x[3] for x in scanner.spans(b" all rights reservedly and so ")] == [2]


def test_every_bounded_edit_of_a_notice_is_found():
    """Pigeonhole: up to k edits leave one of k + 1 pieces whole, so each edited notice is found."""
    rnd = random.Random(8)
    scanner = ls.Scanner(ls.MORE)
    for k, notice in enumerate(ls.MORE):
        for _ in range(40):
            letters = list(notice.words)
            for _ in range(rnd.randint(0, notice.edits)):
                at = rnd.choice([k for k in range(1, len(letters) - 1) if " " not in letters[k - 1 : k + 2]])
                how = rnd.randrange(3)
                if how == 0:
                    letters[at] = rnd.choice("xyz")
                elif how == 1:
                    letters.insert(at, rnd.choice("xyz"))
                else:
                    del letters[at]
            text = b" some words before " + b" ".join("".join(letters).encode().split()) + b" and after "
            assert any(found[0] == k for found in scanner.spans(text)), letters
