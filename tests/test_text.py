"""Text functions: expected strings per case, written from SURVEY section 2.3
and FIXTURES section 6, and character-class checks over whole code ranges."""

import pytest
from pyspark.sql import functions as F

from marketlex.functions import text as tx
from marketlex.functions.lexicon import EMOTICONS

# function -> [(input, expected)]
CASES = {
    "strip_urls": [
        ("see http://a.b/c?d=1 now", "see   now"), ("www.x.pl", " "), ("mid-wordwww.example.com and", "mid-word  and"),
        ("https://t.co/abc", " "), ("no link", "no link"), ("", ""), ("a http\u00a0b", "a http\u00a0b")],
    "strip_hashtags": [("#spółka $CDR", "  $CDR"), ("a#b_1 c", "a  c"), ("# alone", "# alone"), ("#\u0301x", "#\u0301x")],
    "strip_mentions": [("@user_1 zysk", "  zysk"), ("email@host.com", "email .com"), ("@ alone", "@ alone")],
    "strip_cashtags": [("$CDR up", "  up"), ("5$ x", "5$ x"), ("$1a", " ")],
    "keep_polish_text": [("zażółć! gęś? 1,2", "zażółć! gęś? 1 2"), ("été", " t "), ("x_y", "x y"), ("a\tb\nc", "a\tb\nc"), ("🚀", " ")],
    "collapse_repeats": [("aaabbb\n\n\nccc\r\r", "ab\n\n\nc\r"), ("1000 lat 2222", "10 lat 2"), ("wow!!! yes...  no", "wow! yes. no"),
                         ("🚀🚀 ok", "🚀 ok"), ("aA", "aA"), ("", "")],
    "normalize_whitespace": [("  lead and trail  \t", "lead and trail"), ("nbsp\u00a0here em\u3000ideo", "nbsp here em ideo"),
                             ("sep\x1cfile\x1dgroup\x1erecord\x1funit", "sep file group record unit"), ("tabs\t\tand\x0bvt\x0cff", "tabs and vt ff"),
                             ("line1\nline2\r\nline3 sep\u0085nel", "line1 line2 line3 sep nel"), ("   ", "")],
    "sentence_case": [("ala MA. kota! ŻUK? źle\n\nósmy", "Ala ma. Kota! Żuk? Źle\n\nósmy"), ("A. b? c! d.e f", "A. B? C! D.e f"), (". start", ". Start"),
                      ("wow!!! really", "Wow!!! Really"), ("", "")],
    "strip_tco": [(" https://t.co/abc text ", "text"), ("a http://t.co/x", "a"), ("https://x.co/abc", "https://x.co/abc")],
    "clean_text_basic": [("@a x http://t.co/1", "  x  "), ("b", "b")],
    "clean_text_full": [("@user_1 zysk!! #spółka https://t.co/abc koniec", "zysk koniec"), ("x_y_z __init__", "x y z init"),
                        ("zażółć, gęślą!", "zażółć gęślą"), ("🚀 a", "a"), ("  ", "")],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_expected_strings(spark, name):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES[name])], "id int, text string")
    got = {r["id"]: r["x"] for r in df.select("id", getattr(tx, name)("text").alias("x")).collect()}
    assert [got[i] for i in range(len(got))] == [want for _, want in CASES[name]]


@pytest.fixture(scope="module")
def characters(spark):
    """Every code point below U+3100 but the surrogates, one a row."""
    return spark.createDataFrame([(c, f"a{chr(c)}b") for c in range(1, 0x3100)], "cp int, text string")


def test_white_space_class(characters):
    """Exactly the code points that Python calls white space separate tokens."""
    got = {r["cp"] for r in characters.where(F.size(tx.whitespace_tokens("text")) == 2).select("cp").collect()}
    assert got == {c for c in range(1, 0x3100) if chr(c).isspace()}


def test_word_class_of_mentions(characters):
    """A mention runs over letters, digits and the underscore of any script."""
    d = characters.select("cp", tx.strip_mentions(F.concat(F.lit("@"), F.substring("text", 2, 1), F.lit("!"))).alias("x"))
    gone = {r["cp"] for r in d.where(F.col("x") == " !").collect()}
    # code points assigned lately may differ between the two Unicode tables
    assert len(gone ^ {c for c in range(1, 0x3100) if chr(c).isalnum() or c == 95}) < 60
    assert {ord(c) for c in "azAZ09_éżßשд٣あ"} <= gone and not gone & {ord(c) for c in " -.$#@\u0301"}


def test_polish_letters_are_kept(spark):
    letters = "abcxyzABCXYZ0189?!ĄąĆćĘęŁłŃńÓóŚśŹźŻż"
    df = spark.createDataFrame([(letters,)], "text string")
    assert df.select(tx.keep_polish_text("text")).first()[0] == letters
    assert spark.createDataFrame([("äöüñêи日",)], "text string").select(tx.keep_polish_text("text")).first()[0] == " " * 7


def test_null_passes_through(spark):
    df = spark.createDataFrame([(None,)], "text string")
    row = df.select(*[getattr(tx, n)("text").alias(n) for n in CASES],
                    tx.remove_stopwords("text", ["a"]).alias("sw"), tx.replace_emoji("text").alias("em")).first()
    assert all(v is None for v in row)


def test_remove_stopwords(spark):
    df = spark.createDataFrame([("Ala i kot W domu",), ("  i  w  ",), ("",), ("AND\u00a0ok then",)], "text string")
    got = [r[0] for r in df.select(tx.remove_stopwords("text", ["i", "w", "and", "ok"])).collect()]
    assert got == ["Ala kot domu", "", "", "then"]


def test_token_count(spark):
    df = spark.createDataFrame([("a b  c",), ("",), (" \t ",), ("x\u3000y\x1cz",)], "text string")
    assert [r[0] for r in df.select(tx.token_count("text")).collect()] == [3, 0, 0, 3]


# ---- lexicon ---------------------------------------------------------------

def in_order(text, pairs, prefix=" "):
    for k, v in pairs:
        text = text.replace(k, prefix + v)
    return text


def check_lexicon(spark, pairs, texts, prefix=" "):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(tx.replace_lexicon("text", pairs, prefix)).collect()]
    assert got == [None if t is None else in_order(t, pairs, prefix) for t in texts]
    return got


def test_emoticon_order_is_the_contract(spark):
    df = spark.createDataFrame([("a :/) b >:) c",), ("&lt;",), ("XD :D ;)",)], "text string")
    got = [r[0] for r in df.select(tx.replace_emoji("text")).collect()]
    assert got == ["a  sceptyczny b > radosny c", " mniejsze-od;", " rozbawiony  roześmiany  puszczający-oko"]


@pytest.mark.parametrize("pairs, prefix, text, want", [
    ([("x", "y"), ("y", "z")], " ", "x", "  z"),                    # the insertion holds a later key
    ([("a", "b"), ("xb", "Z")], "", "xa", "Z"),                     # it ends one that starts before it
    ([("a", "bc"), ("cd", "Z")], "", "ad", "bZ"),                   # it starts one that ends after it
    ([("a", "v"), ("x vy", "Z")], " ", "xay", " Z"),                # it lies inside one
    ([("a", ""), ("xy", "Z")], "", "xay", "Z"),                     # it is empty
    ([("a", "v"), ("b", "two words"), ("v t", "Z")], " ", "ab", "  v two words"),
])
def test_prefilter_falls_back_when_unsafe(spark, pairs, prefix, text, want):
    if in_order(text, pairs, prefix) == want and len(pairs) == 2:
        assert not tx._prefilter_exact(tuple(pairs), prefix)
    assert check_lexicon(spark, pairs, [text], prefix)[0] == in_order(text, pairs, prefix)


def test_prefilter_is_used_for_the_emoticons():
    assert tx._prefilter_exact(tuple(EMOTICONS))
    assert tx._prefilter_exact(tuple([(chr(0x1F300 + i), f"e{i}") for i in range(9000)] + list(EMOTICONS)))


def test_random_lexicons_match_sequential_replacement(spark):
    import random
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("ab ") for _ in range(n))
    for _ in range(12):
        pairs = [(word(rnd.randint(1, 3)), word(rnd.randint(0, 3))) for _ in range(4)]
        pairs = list({k: (k, v) for k, v in pairs}.values())
        check_lexicon(spark, pairs, [word(rnd.randint(0, 12)) for _ in range(20)], rnd.choice(["", " "]))


def test_large_lexicon_scan_path(spark):
    # one-code-point keys from a rule (enough to take the single-regex-pass
    # path) followed by the multi-character emoticons
    pairs = [(chr(0x1F300 + i), f"e{i}") for i in range(0, 600, 2)] + [("©", "c"), ("ℹ", "info")] + list(EMOTICONS)
    check_lexicon(spark, pairs, ["🌀🌁🌂 :) ©2024 ℹ x", "", "plain text", "🌀🌀 >:( XD &lt;", "\U0001F3FF edge \U0001F300", None])


def test_lexicon_longer_than_one_chunk(spark):
    # 2,500 one-code-point keys (from a rule) + emoticons: two successive folds
    pairs = [(chr(0x4E00 + i), f"c{i}") for i in range(2500)] + list(EMOTICONS)
    assert len(pairs) > tx.LEXICON_CHUNK
    check_lexicon(spark, pairs, ["一 丁 :) 伀 end", "嗃嗄 XD", "none here"])
