"""Wrong decodings: made from clean text by real encode and decode steps, and restored exactly."""

import pytest

from loomtrace.llm import garbled as g

CLEAN = [
    "der Überwachungsfaden prüft die Summe vor dem nächsten Schreiben", "le journal système écrit l’en-tête avant les données déjà reçues",
    "журнал событий отбрасывает старый пакет после попытки", "メモリが足りなくなると、設定の読み込み処理が時間切れを通知する", "如果时钟向后跳动，配置加载程序把作业移到另一条通道",
    "메모리가 부족해지면 프레임 해석기가 예상보다 오래 잠금을 유지한다", "resistance 5 kΩ at terminal 4", "ratio ½ selected for queue", "temperature 12°C on pump", "ﾀｲﾑｱｳﾄ 1042 ﾐﾘﾋﾞｮｳ",
]


@pytest.fixture(scope="module")
def model(spark):
    return g.Plausibility(g.window_counts(spark.createDataFrame([(x,) for x in CLEAN * 40], "t string")))


def test_clean_text_is_left_alone(model):
    for t in CLEAN:
        assert g.judged(t, model)[0] is False


@pytest.mark.parametrize(
    "i,true,wrong",
    [(0, "utf-8", "latin-1"), (1, "utf-8", "cp1252"), (2, "utf-8", "cp1251"), (2, "cp1251", "latin-1"), (2, "koi8-r", "cp1251"), (2, "cp866", "cp1251"), (3, "cp932", "latin-1"), (3, "utf-8", "latin-1"), (4, "gb18030", "latin-1"), (5, "cp949", "gb18030"), (0, "latin-1", "cp437"), (6, "utf-8", "cp437")],
)
def test_round_trip(model, i, true, wrong):
    bad = CLEAN[i].encode(true).decode(wrong)
    found, restored, _ = g.judged(bad, model)
    assert found and restored == CLEAN[i]


@pytest.mark.parametrize("i,true,wrong", [(2, "iso8859-5", "cp1251"), (0, "cp437", "cp1251"), (1, "cp850", "latin-1"), (10, "iso8859-7", "cp1252"), (10, "iso8859-7", "latin-1")])
def test_rarer_charsets(spark, i, true, wrong):
    texts = [*CLEAN, "το αρχείο καταγραφής απορρίπτει το παλιό πακέτο μετά την προσπάθεια"]
    text = texts[i].replace("’", "'")
    model = g.Plausibility(g.window_counts(spark.createDataFrame([(x.replace("’", "'"),) for x in texts * 40], "t string")))
    assert g.judged(text.encode(true).decode(wrong), model)[:2] == (True, text)


def test_twice_and_in_part(model):
    bad = CLEAN[2].encode().decode("cp1251").encode().decode("latin-1")
    assert g.judged(bad, model)[:2] == (True, CLEAN[2])
    half = CLEAN[2][:20] + CLEAN[2][20:].encode().decode("latin-1")
    assert g.judged(half, model)[:2] == (True, CLEAN[2])


def test_right_and_wrong_words(model):
    words = CLEAN[0].split(" ")
    bad = " ".join([words[1], *(w.encode("mac_roman").decode("cp1252") if any(c > "~" for c in w) else w for w in words[2:])])
    assert bad != " ".join(words[1:]) and g.judged(bad, model)[:2] == (True, " ".join(words[1:]))


def test_destroyed(model):
    assert g.judged("la demande est rejet�e", model)[0] is True
    assert g.judged(CLEAN[5].encode("cp949").decode("utf-8", "replace"), model)[0] is True


def test_damaged_before(model):
    for t in ("la demande est rejetï¿½e", "配置加载程序锟斤拷作业", "die PrÃ¼fung der GerÃ?te", CLEAN[5].encode("cp949").decode("utf-8", "replace").encode().decode("cp1252", "ignore")):
        assert g.judged(t, model)[0] is True, t
    assert g.judged("la demande est rejetï¿½e", model)[1] is None
    assert g.judged("is it à la carte? è così", model)[0] is False
    # C1 controls on the way
    assert g.judged("der Überwachungsfaden".encode().decode("latin-1").encode().decode("cp1252"), model)[:2] == (True, "der Überwachungsfaden")


def test_escaped(spark, model):
    bad = "der &Atilde;&frac14;bern&Atilde;&curren;chste Schritt"
    u = lambda t: "".join(c if c < "\x7f" else f"\\u{ord(c):04x}" for c in t)
    rows = [(1, bad), (2, u(CLEAN[0].encode().decode("latin-1"))), (3, u(CLEAN[3])), (4, "rejet\\ufffde"), (5, "'\\ufffd'"), (6, "&amp; \\u0041"), (7, "\\ud83d x \\u0085")]
    got = {r["record_key"]: r["restored"] for r in g.find_garbled(spark, [("t", spark.createDataFrame(rows, "seq long, message string"), "seq", "message", False)], model).collect()}
    assert set(got) == {"1", "2", "4"} and got["2"] == CLEAN[0] and got["4"] is None
    assert g.unescaped("\\ud83d\\ude00 \\ud83d") == "\U0001f600 \\ud83d"


def test_costs_of_many_are_those_of_each(model):
    texts = [*CLEAN, "a\nb é", "", "Ünïcode 123"]
    assert all(abs(a - model.cost(g.folded(t))) < 1e-3 for a, t in zip(model.all_costs(texts), texts))


def test_records(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN * 40)] + [(9001, CLEAN[0].encode().decode("latin-1")), (9001, CLEAN[0].encode().decode("latin-1")), (9002, None), (None, "Ã¼"), (9003, ""), (9004, "plain " * 100_000)]
    logs = spark.createDataFrame(rows, "seq long, message string").withColumn("restored", g.F.lit(1))
    files = spark.createDataFrame([("a.c", "int x;\n// " + CLEAN[1].encode().decode("latin-1") + "\nint y;"), ("b.c", "// " + CLEAN[1]), ("c.c", None)], "path string, content string")
    tables = [("log_entries", logs, "seq", "message", False), ("source_files", files, "path", "content", True)]
    got = {(r["table_name"], r["record_key"]): r["restored"] for r in g.find_garbled(spark, tables).collect()}
    assert got == {("log_entries", "9001"): CLEAN[0], ("source_files", "a.c"): "int x;\n// " + CLEAN[1] + "\nint y;"}
    assert g.find_garbled(spark, [("log_entries", logs.where("false"), "seq", "message", False)]).count() == 0


def test_repetition_is_no_evidence(spark):
    """A garbled message that holds a third of all rows, with numbers that differ, is found in each of them."""
    bad = CLEAN[2].encode("koi8_r").decode("cp1251")
    words = ["очередь", "таймер", "канал", "буфер", "поток", "сокет", "адрес", "ключ", "файл", "узел"]
    clean = [f"{CLEAN[2]} {a} {b} {i}" for i in range(3) for a in words for b in words]
    rows = [(i, t) for i, t in enumerate(clean)] + [(10_000 + i, f"{bad} {i}") for i in range(150)]
    d = spark.createDataFrame(rows, "seq long, message string")
    got = {r["record_key"]: r["restored"] for r in g.find_garbled(spark, [("t", d, "seq", "message", False)]).collect()}
    assert got == {str(10_000 + i): f"{CLEAN[2]} {i}" for i in range(150)}


def test_long_texts(spark, model):
    clean = " ".join(CLEAN[:2] * 300)
    d = spark.createDataFrame([(1, clean.encode().decode("latin-1")), (2, clean), (3, "語" * 50_000), (4, CLEAN[3] * 2000)], "seq long, message string")
    got = {r["record_key"]: r["restored"] for r in g.find_garbled(spark, [("t", d, "seq", "message", False)], model).collect()}
    assert got.get("1") == clean and "2" not in got and "4" not in got


def test_escapes():
    assert g.unescaped("caf&eacute; \\u00e9 &amp;") == "café é &amp;" or g.unescaped("caf&eacute;") == "café"
    assert g.nucleus("lock 0x12 acquired after 54.06 µs now and then") == "0.0 µs now"


def test_nothing_is_made_twice(monkeypatch):
    """Both tables of counts search one graph: no text's bytes are made twice, and a worker's later tasks know what it judged."""
    asked = []
    encoded = g._encoded
    monkeypatch.setattr(g, "_encoded", lambda t, x: asked.append((t, x)) or encoded(t, x))
    counts = g.np.ones(g.BUCKETS, g.np.int64)
    model = g.Plausibility(counts, counts)
    bad = CLEAN[5][4:].encode("cp949").decode("utf-8", "replace")
    assert g.judged(bad, model)[:2] == (True, None)
    assert asked and len(asked) == len(set(asked))
    task = lambda: [tuple(r) for d in g._judge(model, "t", "k", False)(iter([g.pd.DataFrame({"k": ["1"], "t": [bad]})])) for r in d.itertuples(index=False)]
    first = task()
    judged = g.judged
    monkeypatch.setattr(g, "judged", lambda *a: pytest.fail("judged again"))
    assert task() == first == [("1", None)]
    monkeypatch.setattr(g, "judged", judged)
    again = g.Plausibility(counts, counts)
    assert g._seen(again) == {} and g._seen(again) is not g._seen(model)  # of another corpus nothing is known


def test_judgements_fit_in_memory(monkeypatch):
    """Workers keep judgements for later tasks, by the characters of their texts, not only by their number."""
    monkeypatch.setattr(g, "_CACHE_CHARS", 5000)
    seen = g._Seen()
    for i in range(100):
        seen.keep((f"{i:04}" * 250, False), (False, ()))
        assert sum(len(t) for t, _ in seen) == seen.chars <= 6000 and len(seen) >= 1


@pytest.mark.parametrize("wrong", g.WRONG)
def test_bytes_of_all_pieces_at_once(wrong):
    texts = [*CLEAN, "", "é", "Ã© naïve ﾀｲx", "\ud83d ö\x85ü \U0001f600", *(x.encode().decode("latin-1") for x in CLEAN), *(x.encode("utf-8").decode("cp1251", "replace") for x in CLEAN)]
    for t in texts:
        pieces = g._encoded(t, wrong)
        assert "".join(x for x, _ in pieces) == t
        for x, raw in pieces:
            if raw is None:
                assert all(c not in g._UP[wrong] for c in x) if wrong in g._UP else x.encode(wrong, "ignore") == b""
            else:
                assert raw.decode("latin-1").translate(dict(enumerate(g._UP[wrong]))) == x if wrong in g._UP else x.encode(wrong) == raw
        joined = g._joined(pieces)
        for true in g._UP:
            if true != wrong:
                assert g._swapped(t, joined, g._raw(joined), true) == g._step(pieces, true, wrong)
