from muster.llm.names import assign, deletes, long_keys, name_entities, name_pairs, one_for_one, org_tokens, person_parts


def name_variants(df):
    return name_pairs(name_entities(df))


def test_parts():
    assert person_parts("dr. deborah l.|panbid, esq.")[:3] == ("deborah", "panbid", "")
    assert person_parts("deborah panbid|")[:3] == ("deborah", "panbid", "") == person_parts("|panbid, deborah")[:3]
    assert person_parts("ann|marsh jr.")[2] == "jr" and person_parts("anonymous|") is None and person_parts("|") is None
    assert org_tokens("the marsh river & dairy comm. inc.") == ["marsh", "river", "dairy", "committee"]
    assert "marh" in deletes("marsh")
    assert assign(["j", "marsh"], ["marsh", "john"]) > 0.8 and assign(["alpha"], ["omega"]) == 0.0


def names(n, seed):
    import random

    rng = random.Random(seed)
    syl = ["bran", "del", "fen", "gor", "hup", "kem", "lot", "mis", "nuk", "pru", "rals", "tov"]
    return ["".join(rng.sample(syl, 4)) for _ in range(n)]


def test_variants(spark):
    stems = names(12, 4)
    kinds = ["Dairy Council", "River Alliance", "Housing Federation"]
    orgs = [f"{s.title()} {kinds[k % 3]}" for k, s in enumerate(stems)]
    s0 = stems[0].title()
    typed = [f"{s0} Dairy Council", f"The {s0} Dairy Council Inc.", f"Dairy Council of {s0}", f"{s0[:5]} {s0[5:]} Dairy Coun.", f"{s0}s Dairy Council", f"{s0} River Alliance", "N/A", "", None, "-", "x" * 3000]
    sur = names(8, 9)
    people = [(g, s) for g, s in zip(["Deborah", "Margaret", "Thomas", "Robert", "Susan", "Anthony", "Victoria", "Samuel"], sur)] * 1
    p0 = sur[0]
    people += [("Debbie", p0), ("D.", p0), (f"Deborah {p0}", None), (None, f"{p0}, Deborah"), ("Dr. Deborah", p0), ("Drborah", p0), ("Thomas", p0), ("Deborah", f"{p0} Jr."), ("Anonymous", None), (None, None)]
    rows = [(o, None, None, "clash") for o in orgs + typed] + [(None, a, b, "clash") for a, b in people] * 2
    df = spark.createDataFrame(rows, "organization string, submitter_first string, submitter_last string, name string")
    got = {tuple(r) for r in name_variants(df).collect()}
    assert all(a < b for _, a, b in got)
    low = lambda x: " ".join(x.lower().split())
    same = sorted({low(x) for x in typed[:5]})
    want = {("org", a, b) for k, a in enumerate(same) for b in same[k + 1 :]}
    assert {x for x in got if x[0] == "org"} == want
    mine = sorted([f"deborah|{p0}", f"debbie|{p0}", f"d.|{p0}", f"deborah {p0}|", f"|{p0}, deborah", f"dr. deborah|{p0}", f"drborah|{p0}"])
    assert {x for x in got if x[0] == "person"} == {("person", a, b) for k, a in enumerate(mine) for b in mine[k + 1 :]}
    assert name_variants(df.where("1 = 0")).count() == 0


def test_swapped_fields_stay_swapped_as_rows_grow(spark):
    """Each surname is seen as a given name with more than ATTESTED partners, as each given name as a surname."""
    givens = ["Wilbur", "Hortense", "Cuthbert", "Griselda", "Ottoline", "Barnaby", "Persephone", "Leopold"]
    sur = names(8, 9)
    rows = [(None, g, s) for g in givens for s in sur] * 4 + [(None, s, g) for g in givens for s in sur]
    df = spark.createDataFrame(rows, "organization string, submitter_first string, submitter_last string")
    got = {tuple(r) for r in name_variants(df).collect()}
    assert got == {("person", *sorted((f"{g}|{s}".lower(), f"{s}|{g}".lower()))) for g in givens for s in sur}


def test_short_forms_in_no_list(spark):
    """Abbreviations that no list holds are linked by the assignment of tokens; sister organisations are not."""
    stems = [x.title() for x in names(12, 4)]
    kinds = ["Watershed Conservancy", "Teamsters Chapter", "Growers Guild"]
    orgs = [f"{s} {kinds[k % 3]}" for k, s in enumerate(stems)]
    s0 = stems[0]
    typed = [f"{s0} Wtrshed Consrvcy", f"{s0} Watershed Conserv.", f"{s0} Teamsters Chapter", f"{s0} Growers Guild"]
    people = [("Konstantin", "Brandel"), ("Konst", "Brandel"), ("Kassandra", "Brandel")]
    df = spark.createDataFrame([(o, None, None) for o in orgs + typed] + [(None, a, b) for a, b in people], "organization string, submitter_first string, submitter_last string")
    got = {tuple(r) for r in name_variants(df).collect()}
    same = sorted(x.lower() for x in [orgs[0], typed[0], typed[1]])
    assert got == {("org", a, b) for k, a in enumerate(same) for b in same[k + 1 :]} | {("person", "konstantin|brandel", "konst|brandel")}


def test_assignment_decides():
    assert one_for_one(["marsh", "wtrshed"], ["marsh", "watershed"], {"watershed"})
    assert not one_for_one(["marsh", "alliance"], ["marsh", "association"], {"alliance", "association"})
    assert not one_for_one(["marsh", "dairy", "council"], ["marsh", "council"], set())


def test_long_tokens_with_slips(spark):
    long_ = "".join(chr(97 + (k * 7 + k // 5) % 26) for k in range(90))
    swapped = long_[:44] + long_[45] + long_[44] + long_[46:]
    assert long_keys(long_) & long_keys(swapped) and long_keys(long_) & long_keys(long_[:30] + long_[32:])
    rows = [(f"{w} Dairy Council",) for w in (long_, long_, swapped, long_[:10] + long_[12:])]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "organization string, submitter_first string, submitter_last string")
    assert name_variants(df).count() == 3


def test_pieces_that_recur_in_many_names_are_no_ordinary_words(spark):
    """In a larger table a piece of an invented word goes with many others; its names still meet when typed in one word and in two."""
    import random

    rng = random.Random(3)
    others = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(7000)]
    tails = ["thomvo", "krelpu", "sindra", "gofbey", "lutzmi", "charno"]
    typed = [f"{a} dairy council" for t in tails for a in (f"wammu{t}", f"wammu {t}")]
    df = spark.createDataFrame([(f"{x} {('dairy', 'river', 'timber')[k % 3]} council", None, None) for k, x in enumerate(others)] + [(x, None, None) for x in typed], "organization string, submitter_first string, submitter_last string")
    got = {tuple(r) for r in name_variants(df).collect()}
    assert {("org", f"wammu {t} dairy council", f"wammu{t} dairy council") for t in tails} == {x for x in got if "wammu" in x[1]}


def test_near_surnames_of_others_leave_initials_told(spark):
    """Surnames lie within slips of each other in a larger table; an initial is told by the names of its own surname."""
    people = [("Deborah", "branfendel"), ("D.", "branfendel"), ("Dr. Deborah", "branfendel"), ("Debbie", "branfendle"), ("David", "branfendol"), ("David", "branfendol, esq."), ("David B.", "branfendol"), ("Dr. David", "branfendol")]
    df = spark.createDataFrame([(None, *x) for x in people], "organization string, submitter_first string, submitter_last string")
    got = {tuple(r) for r in name_variants(df).collect()}
    want = set()
    for own in (people[:4], people[4:]):
        low = sorted("|".join(x).lower() for x in own)
        want |= {("person", a, b) for k, a in enumerate(low) for b in low[k + 1 :]}
    assert got == want


def test_slip_beside_an_abbreviation_in_no_list(spark):
    stems = [x.title() for x in names(12, 4)]
    orgs = [f"{s} Watershed Conservancy" for s in stems[:6]] + [f"{s} Teamsters Chapter" for s in stems[6:]]
    s0 = stems[0]
    typed = f"{s0[:4]}{s0[5:]} Watershed Conserv."
    df = spark.createDataFrame([(o, None, None) for o in [*orgs, typed]], "organization string, submitter_first string, submitter_last string")
    assert {tuple(r) for r in name_variants(df).collect()} == {("org", *sorted((orgs[0].lower(), typed.lower())))}
