"""Natural language in sources: the lexer, stretches, languages, shares."""

import pytest

from loomtrace.llm import codelang as c

DOCS = {
    "en": "the message broker closes the channel without a final reply because the peer has not answered. the timer wheel reads the table again.",
    "de": "der Überwachungsfaden prüft die Summe vor dem nächsten Schreiben, weil die Gegenstelle nicht geantwortet hat. die Warteschlange wartet.",
    "fr": "le journal système écrit l’en-tête avant les données parce que le correspondant n’a pas répondu. la table des sessions attend.",
    "es": "el gestor de memoria vuelve a leer la configuración porque el otro extremo no respondió. la cola de envío espera.",
    "pt": "o gestor de memória lê novamente a configuração porque o outro lado não respondeu. a fila de transmissão espera.",
    "ru": "журнал событий отбрасывает старый пакет потому что другая сторона не ответила.",
    "ja": "相手側から応答がないため、設定の読み込み処理が時間切れを通知する。", "zh": "因为对方没有回应，配置加载程序把作业移到另一条通道。", "ko": "상대가 응답하지 않았기 때문에 설정 읽기 모듈이 시간 초과를 알린다.",
}
CODE = """#include "os.h"
/* die Summe prueft der Faden vor dem naechsten Schreiben */
int f(int a) { if (a > 4) { return g(a, "the peer has not answered again"); } return 0; } // rc = x(3); y[2] += 1;
// the timer wheel reads \\
   the table again
/* The queue closes the channel.
 * la cola de envío espera en la memoria
 */
const char *s = "\\u76f8\\u624b\\u5074\\u304b\\u3089\\u5fdc\\u7b54\\u304c\\u306a\\u3044", q = '"', *u = "\\xec\\x83\\x81\\xeb\\x8c\\x80\\xea\\xb0\\x80 \\354\\235\\221\\353\\213\\265 no \\uc751\\ub2f5 \\uc54a \\uc788";
#if 0
/* 因为对方没有回应，作业移到另一条通道 */
#endif
char *p = "/* not a comment, two words */"; // see above
auto r = R"(le journal système écrit
les données avant)";
"""


def test_pieces():
    got = [(n, k) for n, k, *_ in c.pieces(CODE)]
    assert got == [(1, "str"), (2, "block"), (3, "str"), (3, "line"), (4, "line"), (6, "block"), (9, "str"), (9, "str"), (11, "block"), (13, "str"), (13, "line"), (14, "raw")]
    assert c.pieces("") == [] and [p[:2] for p in c.pieces("a /* open\nend")] == [(1, "block")]
    assert c.code_only('f("x"); // y\n/* z */ g();').split() == ["f(", '""', ");", "g();"]


def test_unescaped():
    assert c.unescaped(r"a\tb\"c\"\né\xc3\xa9\303\251") == 'a\tb"c"\néé é'.replace(" ", "")


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k.upper() if k == "de" else k + "-XX", v) for k, v in DOCS.items()] + [(None, "x"), ("en", None)], "lang string, text string")
    files = spark.createDataFrame([("a.c", CODE), ("a.c", CODE), ("b.c", None), (None, CODE), ("e.c", ""), ("crlf.c", "int a;\r\n/* the timer wheel reads the table */\r\n")], "path string, content string").withColumn("lang", c.F.lit("x"))
    return c.natural_language(files, docs).cache()


def test_found(found):
    got = {(r["path"], r["line_no"], r["lang"]) for r in found.collect()}
    want = {(2, "de"), (3, "en"), (4, "en"), (6, "en"), (6, "es"), (9, "ja"), (9, "ko"), (11, "zh"), (13, "en"), (14, "fr")}
    assert {x for x in got if x[0] == "a.c"} - {("a.c", 13, "en")} == {("a.c", *x) for x in want} - {("a.c", 13, "en")}
    assert {x for x in got if x[0] != "a.c"} == {("crlf.c", 2, "en")}


def test_shares(found):
    rows = c.language_shares(found).collect()
    assert all(0 < r["share"] < 1 for r in rows) and {r["path"] for r in rows} == {"a.c", "crlf.c"}


def test_no_files(spark):
    docs = spark.createDataFrame([("en", DOCS["en"])], "lang string, text string")
    assert c.natural_language(spark.createDataFrame([], "path string, content string"), docs).count() == 0


def test_short_sentences():
    assert c.stretches("Lock held. Do not sleep.") == [("latin", "Lock held. Do not sleep.")]
    assert [k for k, _ in c.stretches("写入失败了。请稍后重试。")] == ["cjk"]
    assert c.stretches("Done. The queue closes the channel. Wait.") == [("latin", "Done. The queue closes the channel. Wait.")]
    assert c.stretches("Do not. Sleep.") == []
    # signs part nothing any more: whether such a stretch is code is the posterior's to say
    assert c.stretches("x = y[2]; z += 1. Lock held.") == [("latin", "x = y[2]; z += 1. Lock held.")]


def test_code_by_posterior(spark):
    docs = spark.createDataFrame(list(DOCS.items()), "lang string, text string")
    lines = "x = y[2]; z += 1;\nfor (i = 0; i < n; i++) sum += tab[i];\nif (rc) { return rc; }\n"
    files = spark.createDataFrame([("a.c", lines * 5 + "// for (i = 0; i < n; i++) sum += tab[i];\n// x = y[2]; z += 1; if (rc) return rc;\n// THE TIMER WHEEL READS THE TABLE AGAIN\n")], "path string, content string")
    assert [(r["line_no"], r["lang"]) for r in c.natural_language(files, docs).collect()] == [(18, "en")]
