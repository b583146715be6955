import pytest

from muster.llm.pii import find_personal_data, find_spans, redact, redact_texts

CASES = [
    ("Reach me at jo.marsh@post.example after work.", [("email", "jo.marsh@post.example")]),
    ("write to jo at post dot co dot example please", [("email", "jo at post dot co dot example")]),
    ("email jo[at]post.test (Contact: kim (at) post (dot) test)", [("email", "jo[at]post.test"), ("email", "kim (at) post (dot) test")]),
    ("Fees ran @ 24.1 percent. Follow @watch for more.", []),
    ("Call (711) 555-0112 or +44 20 7946 0413 or 788.133.0736 today", [("phone", "(711) 555-0112"), ("phone", "+44 20 7946 0413"), ("phone", "788.133.0736")]),
    ("call five five five two one two three four five six now", [("phone", "five five five two one two three four five six")]),
    ("Invoice 7892153236 covers it. Case 254-2954 was closed. My claim no. 887-554-3986 is open.", []),
    ("SSN: 000-38-3029 and my social as 158 89 0000; passport, Q0419590; licence, D206-2626-97", [("id_number", "000-38-3029"), ("id_number", "158 89 0000"), ("id_number", "Q0419590"), ("id_number", "D206-2626-97")]),
    ("NI no. QQ 97 26 62 B is mine", [("id_number", "QQ 97 26 62 B")]),
    ("I live at 4228 West Ponow Drive, Marsh. Send to P.O. Box 348 or One Birow Plaza.", [("address", "4228 West Ponow Drive"), ("address", "P.O. Box 348"), ("address", "One Birow Plaza")]),
    ("Main Street lenders pay 490.31 a day. Room 12, second floor.", []),
    ("As Samuel H. Brown told the board; Mr. Boroway signed; the agent, Nokucci, Desmond, never called.", [("person_name", "Samuel H. Brown"), ("person_name", "Boroway"), ("person_name", "Nokucci, Desmond")]),
    ("ＲｅａｃＨ: jo​hn@post.example", [("email", "jo​hn@post.example")]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_spans(text, want):
    got = [(k, text[a:b]) for a, b, k in find_spans(text)]
    assert [k for k, _ in got] == [k for k, _ in want]
    for (_, g), (_, w) in zip(got, want):
        assert g.startswith(w) or w.startswith(g.rstrip(" ,.")), (g, w)


def test_redacted_text_stays_readable():
    assert redact("Call (711) 555-0112 now, says Mr. Boroway.") == "Call [PHONE] now, says Mr. [NAME]."
    assert redact("email kim (at) post (dot) co (dot) test or call five five five two one two three four five six now") == "email [EMAIL] or call [PHONE] now"
    assert redact("Name: Marsh, Ann In our street") == "Name: [NAME] In our street"
    assert redact("nothing here") == "nothing here" and redact("") == "" and redact(None) is None


def test_tables(spark):
    long = "word " * 20_000 + "jo@post.example"
    rows = [("a", "jo@post.example", 1), ("a", "jo@post.example", 1), ("b", None, 1), ("c", "", 1), ("d", long, 1)]
    df = spark.createDataFrame(rows, "id string, text string, kind int")
    got = {tuple(r)[:3] for r in find_personal_data(df, "id", "text").collect()}
    assert got == {("a", "email", 0), ("d", "email", 100_000)}
    assert {r.id: r.text for r in redact_texts(df, "id", "text").collect()}["a"] == "[EMAIL]"
    assert find_personal_data(df.where("1 = 0"), "id", "text").count() == 0


def test_names_in_no_list_and_streets_first():
    """Names are told by where and how they stand; none of these is in the list of given names."""
    for name in ("Zsofia Kovacs", "Hiroshi Tanaka", "Oyelaran Adebayo-Cole", "Wim de Vries".replace("de ", "De "), "Xochitl R. Quispe"):
        for text in (f"No more of it.\n\nYours, {name}", f"Sincerely,\n{name}\nretired nurse", f"My name is {name}, and I farm.", f"/s/ {name}"):
            at = text.index(name)
            assert (at, at + len(name), "person_name") in find_spans(text), text
    for text in ("Sincerely,\nRiverside Dairy Alliance", "Thanks, Federal Commission", "Respectfully submitted, The Board", "Regards, and good luck"):
        assert not [s for s in find_spans(text) if s[2] == "person_name"], text
    text = "Je demeure au 12 Rue de Rivoli depuis dix ans, ou 7 calle del Prado."
    assert [text[a:b] for a, b, k in find_spans(text) if k == "address"] == ["12 Rue de Rivoli", "7 calle del Prado"]


def test_nothing_is_cut_short():
    local = "a" * 300
    text = f"Write to {local}@mail.example.org or docket{' ' * 60}555-12-3456"
    assert [(text[a:b], k) for a, b, k in find_spans(text)] == [(f"{local}@mail.example.org", "email")]
    name = "Marsh" + "wood" * 30
    text = f"Name: {name}, Deborah"
    assert [text[a:b] for a, b, k in find_spans(text)] == [f"{name}, Deborah"]


def test_work_grows_with_the_text():
    import time

    began = time.perf_counter()
    spans = find_spans("mail ann@example.org or 555-123-4567. " * 20_000)
    assert len(spans) == 40_000 and time.perf_counter() - began < 30
