"""Problem 5: personal data in free text, found and replaced by typed placeholders.

A text is first brought to a plain form, character by character, with the place of each plain
character in the source kept: look-alike letters and wide forms become ASCII, invisible
characters go, spelled digits in a row become digits, at/dot disguises of mail addresses become
@ and full stops. Identifiers are detected in the plain form and their spans mapped back. Names
are found beside known given names and titles, and by their shape where a name is due (after a
closing, "my name is", "/s/" and the like), whatever the name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "ο": "o", "α": "a", "ν": "v", "ι": "i", "–": "-", "—": "-", "‐": "-", "‑": "-", "−": "-", "’": "'", "‘": "'"}
INVISIBLE = {"​", "‌", "‍", "⁠", "﻿", "­"}
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
# Given names, as common in public name lists.
GIVEN = """aaron abigail adam alan albert alexander alice amanda amy andrea andrew angela ann anna anthony arthur arvid barbara barnaby benjamin bernice betty brandon brenda brian carl carol catherine charles christina christine christopher constantin cuthbert cynthia daniel david deborah dennis desmond diana donald donna dorothy douglas edward elizabeth emily emma eric ethan eugene evelyn ezekiel fatima frances frank frederick gary george gerald gideon gloria grace gregory hannah harold heather helen henrietta henry hugo ignatius ingrid jack jacob james janet janice jason jean jeffrey jennifer jeremy jerry jessica joan john jonathan jose joseph josephine joshua joyce judith julia julie justin karen katherine kathleen keith kelly kenneth kevin kofi kyle larry lars laura lawrence leonard linda lisa louis lucinda mabel margaret maria marie martha mary matthew megan melissa michael michelle milo nancy natalie nathan nicholas noah noemi odette olivia oswald pamela patricia patrick paul peter philip philippa priya quincy rachel ralph raymond rebecca rhoda richard robert roger ronald russell ruth ryan samantha samuel sandra sarah scott sharon shirley sophia stephanie stephen steven susan tamsin teresa theodore thomas timothy tyler ursula victoria viggo vincent virginia walter wanda wayne william xiomara yolanda zachary""".split()
STREETS = "street|str|st|avenue|ave|av|lane|ln|road|rd|boulevard|blvd|drive|dr|court|ct|place|pl|way|terrace|ter|parkway|pkwy|highway|hwy|circle|cir|square|sq|alley|trail|row|plaza|plz"
FOREIGN_STREETS = ("rue ", "boulevard ", "avenue ", "chemin ", "impasse ", "allée ", "allee ", "quai ", "calle ", "avenida ", "paseo ", "camino ", "plaza ")
STREET_WORDS = set(STREETS.split("|"))
LONG_STREETS = [w for w in STREETS.split("|") if len(w) > 3] + ["lane", "road", "county road", " ave", " blvd", " rd", " st ", " st.", " dr."]
#: Words that may not be taken for a surname after a lower-case given name.
NOT_SURNAMES = set("and the who has had was were are not got told for with from that this they but said says did does will would can could may might also she her his him our your their its lost never signed asked wrote called sent here there when where which while about into over than then very some any all one two".split())
NOT_BEFORE_COMMA = set("thanks sincerely respectfully regards truly yours cordially faithfully dear hello hi cheers best signed name agent sirs madam neighbor".split())

_NUMBER = r"(?:(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand)\b[ -]?(?:and )?){1,6}"
_DIRECTION = r"(?:(?:N|S|E|W|NE|NW|SE|SW)\b\.?[ \xa0]+|(?:north|south|east|west)[ \xa0]+)?"
_UNIT = r"(?:,?[ \xa0]+(?:apt|apartment|unit|suite|ste|#)\b\.?[ \xa0]*[\w-]+)?"
ADDRESS = re.compile(rf"\d(?<![\w$.,/-]\d)\d{{0,5}}(?:-?[A-Za-z])?[ \xa0]+(?:(?:county|state|rural)[ \xa0]+(?:road|route|rd|highway)[ \xa0]+\d+|{_DIRECTION}[^\W\d_][\w'-]+[ \xa0]+(?:[^\W\d_][\w'-]+[ \xa0]+)?(?:{STREETS})\b\.?){_UNIT}", re.I)
WORD_ADDRESS = re.compile(rf"\b{_NUMBER}[ \xa0]*{_DIRECTION}(?:county[ \xa0]+road[ \xa0]+\d+|[A-Z][\w'-]+[ \xa0]+(?:{STREETS})\b\.?){_UNIT}", re.I)
PO_BOX = re.compile(r"(?:P\.?[ \xa0]?O\.?[ \xa0]?|post[ \xa0]office[ \xa0])box[ \xa0]+(?:no\.?[ \xa0]*)?(?:\d+|[a-z]+)", re.I)
EMAIL = re.compile(r"(?<![\w.+%-])([\w.+%-]++)[ \xa0]?@[ \xa0]?[\w-]++(?:\.[\w-]+)*\.[a-z]{2,}", re.I)
#: Addresses with the kind of street first, as in French and Spanish.
STREET_FIRST = re.compile(r"\d(?<![\w$.,/-]\d)\d{0,4},?[ \xa0]+(?:(?:bis|ter)[ \xa0]+)?(?:rue|boulevard|avenue|chemin|impasse|all[ée]e|quai|calle|avenida|paseo|camino|plaza)[ \xa0]+(?:(?:de|du|des|la|le|les|los|las|del|el|l'|d')[ \xa0]*)*(?-i:[^\W\d_a-z])[\w'-]+(?:[ \xa0]+(?-i:[^\W\d_a-z])[\w'-]+)?", re.I)
#: at/dot disguises: the local part, the at, then names joined by dots of either kind.
DISGUISE = re.compile(r"([\w.+%-]+)([ \xa0]*(?:\(at\)|\[at\]|\{at\}|<at>|[ \xa0]at[ \xa0]|@)[ \xa0]*)([\w-]+(?:(?:[ \xa0]*(?:\(dot\)|\[dot\]|\{dot\}|<dot>)[ \xa0]*|[ \xa0]dot[ \xa0]|\.)[\w-]+)+)", re.I)
DOT = re.compile(r"[ \xa0]*(?:\(dot\)|\[dot\]|\{dot\}|<dot>)[ \xa0]*|[ \xa0]dot[ \xa0]", re.I)
PHONE = re.compile(r"[(+\d](?<![\w$.,/#-].)(?:(?<=\+)\d{1,3}(?:[ \xa0.-]?\(?\d{2,4}\)?){2,4}|(?<=\()\d{3}\)[ \xa0]?\d{3}[ \xa0.-]?\d{4}|(?:(?<=1)[ .-])?(?:(?<=[ .-])\d|(?<=\d))\d{2}(?:[ \xa0]?[-./ ][ \xa0]?)\d{3}[ \xa0]?[-./ ]?[ \xa0]?\d{4}|(?<=\d)\d{9}|(?<=\d)\d{2}-\d{4})(?![\w/-]|\.\d)(?:[ \xa0]*(?:ext|x)\.?[ \xa0]*\d+)?")
SSN = re.compile(r"\d(?<![\w$.,/-]\d)\d\d([-. \xa0])\d\d\1\d{4}(?![\w-]|[./]\d)")
NINE = re.compile(r"(?:\bssn|\bsocial(?: security)?(?: (?:number|no\.?|as|is|card))*)[ \xa0:#]*(?:is|as)?[ \xa0:#]*(\d{9})(?!\w)", re.I)
NATIONAL = re.compile(r"[0-9](?<![0-9][0-9])[0-9][ \xa0-]?[0-9]{2}[ \xa0-]?[0-9]{2}[ \xa0-]?[A-Da-d]\b")
NATIONAL_PREFIX = re.compile(r"\b(?:[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]|QQ)[ \xa0-]?$", re.I)
LICENCE = re.compile(r"(?:licen[cs]e|passport|\bDL)\b(?:[ \xa0]+(?:no|number|num|id|is|was))*[.:,# \xa0]*\b([A-Z]\d{6,8}|[A-Z]\d{3}-\d{4}-\d{2}|[A-Z]?\d{8,9})\b", re.I)
#: Numbers of these don't belong to a person.
OTHER_NUMBER = re.compile(r"(?:invoice|upc|claim|case|loan|tracking|order|docket|account|ticket|item|serial|part|policy|permit|parcel|lot|model|isbn|passed|page|room|form|rule|section|sec|bill|file|reference|ref|batch|sku)\b(?:[ \xa0]+(?:no|number|num|id|code))?[.:# \xa0]*$", re.I)
TITLES = "mr mrs ms miss mx dr prof professor rev hon judge senator sen rep".split()
SURNAME = r"[^\W\d_][^\W\d_']+(?:-[^\W\d_]+)*"
AFTER_GIVEN = re.compile(rf"(?:[ \xa0]+[^\W\d_]\.?(?!\w))*[ \xa0]+({SURNAME})(?![\w@])")
AFTER_TITLE = re.compile(rf"\.?[ \xa0]+((?:[^\W\d_]\.[ \xa0]+)*({SURNAME}))")
INITIAL_NAME = re.compile(rf"\b[A-Z]\.(?:[ \xa0]?[A-Z]\.)?[ \xa0]+({SURNAME})(?![\w@])")
CUE = re.compile(r"(?:/s/|--|\bsincerely,|\bthanks,|\brespectfully,|\bregards,|\bname:|\bi am|\bask|\bneighbor|\bit was|\bstreet only|\bagent,|\bas|\bboth|\bsigned,?|\bdear|^|[\n>])[ \xa0]*$", re.I)
#: Where a name is due, whatever it is, and the shape of one.
DUE = re.compile(r"(?:/s/|\b(?:sincerely|respectfully(?: submitted)?|regards|yours(?: truly| faithfully| sincerely)?|cordially|faithfully|thanks|thank you|signed|my name is|name:|signature:))[,:.!]?(?:[ \xa0\r\n]|<[^<>]*>)*", re.I)
_CAPITAL = r"[^\W\d_a-z](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
SHAPE = re.compile(rf"{_CAPITAL}(?:[ \xa0]+[A-Z]\.?(?!\w))*(?:[ \xa0]+{_CAPITAL}){{1,2}}(?=[ \xa0]*(?:$|[\r\n<,;.!(]|and\b|from\b|[-–—]))")
#: Words that organisations, offices and places are named by; no name of a person holds one.
NOT_IN_NAMES = set("association society committee cooperative foundation institute coalition alliance corporation company federation council department agency commission board bureau office union university college school church center centre group team staff member members secretary director president chair chairman citizens residents neighbors friends city town county state states street road avenue national international regional american united federal public service services docket rule comment comments dear sir madam the this that these we you it my our please concerned resident citizen taxpayer voter veteran parent teacher farmer owner north south east west inc llc ltd".split())
_NAME = re.compile(r"[^\W\d_]+")
_SPELLED = re.compile(r"\b(?:(?:%s)\b[ -]?){6,}(?:%s)\b" % ("|".join(DIGITS), "|".join(DIGITS)), re.I)

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[NAME]"}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in TITLES:
        a.add_word(w, (w, True))
    for w in GIVEN:
        a.add_word(w, (w, False))
    a.make_automaton()
    return a


_GIVEN = None
_GIVEN_SET = set(GIVEN)


def _undisguised(m: re.Match) -> str | None:
    """local@domain, unless the match is a plain address or ordinary words around "at"."""
    spelled = DOT.search(m[3])
    at = m[2].strip().lower()
    if at == "@" and not spelled or at == "at" and not spelled or not re.search(r"[a-z]{2}$", m[3], re.I):
        return None
    return m[1] + "@" + DOT.sub(".", m[3])


def plain_form(text: str) -> tuple[str, list[int] | None]:
    """The plain form, and the place in text of each of its characters and of its end (None where they are the same)."""
    places: list[int] | None = None
    if not text.isascii():
        out, places = [], []
        for k, c in enumerate(text):
            if c in INVISIBLE:
                continue
            if ord(c) > 127 and c != "\xa0":
                c = LOOKALIKES.get(c) or (w if len(w := unicodedata.normalize("NFKC", c)) == 1 else c)
            out.append(c)
            places.append(k)
        places.append(len(text))
        text = "".join(out)
    low = text.lower()
    if "dot" in low or any(x in low for x in ("(at)", "[at]", "{at}", "<at>")):
        text, places = _rewrite(text, places, DISGUISE, _undisguised)
    if sum(map(low.count, DIGITS)) >= 7:
        text, places = _rewrite(text, places, _SPELLED, lambda m: "".join(DIGITS[w] for w in re.findall(r"[a-z]+", m[0].lower())))
    return text, places


def _rewrite(text: str, places: list[int] | None, pattern: re.Pattern, new) -> tuple[str, list[int] | None]:
    """Matches replaced by new(match); of its characters the first takes the match's first place, the last its last."""
    out, kept, at = [], [], 0
    where = places if places is not None else range(len(text) + 1)
    for m in pattern.finditer(text):
        s = new(m)
        if s is None:
            continue
        out += [text[at : m.start()], s]
        kept += where[at : m.start()]
        wide = m.end() - m.start()
        kept += [where[m.start() + min(k, wide - 1)] for k in range(len(s) - 1)] + [where[m.end() - 1]]
        at = m.end()
    if not out:
        return text, places
    return "".join(out) + text[at:], [*kept, *where[at : len(text)], where[len(text)]]


def _surname_before(text: str, at: int) -> int | None:
    """Where the surname begins whose comma and blanks end at a given name, if there is one."""
    k = at
    while k and text[k - 1] in " \xa0":
        k -= 1
    if k == at or not k or text[k - 1] != ",":
        return None
    end = k = k - 1
    while k and (text[k - 1].isalpha() or text[k - 1] in "-'"):
        k -= 1
    while k < end and not text[k].isalpha():
        k += 1
    return k if k < end else None


def _of_something_else(form: str, at: int) -> bool:
    """Does a word for a docket, claim or the like, with blanks and signs after it, stand before a number?"""
    end = at
    while end and form[end - 1] in ".:# \xa0":
        end -= 1
    return bool(OTHER_NUMBER.search(form, max(0, end - 24), at))


def _due_names(text: str, low: str, add) -> None:
    """Names of any spelling where one is due: two or three capitalised words up to the end of a line or clause."""
    for cue in DUE.finditer(text):
        m = SHAPE.match(text, cue.end())
        if m is None:
            continue
        words = [w.lower() for w in re.split(r"[ \xa0]+", m.group())]
        if any(w.strip(".,") in NOT_IN_NAMES or w in NOT_SURNAMES or w in STREET_WORDS for w in words):
            continue
        if not m.group().isupper() or re.search(r"[\n,:>]|/s/", cue.group()):  # in capitals throughout the shape tells nothing
            add("person_name", m.start(), m.end())


def _names(text: str, low: str, add) -> None:
    global _GIVEN
    if _GIVEN is None:
        _GIVEN = _automaton()
    n = len(low)
    for end, (w, title) in _GIVEN.iter(low):
        a, b = end - len(w) + 1, end + 1
        if (a and (low[a - 1].isalnum() or low[a - 1] in "_@.+-")) or (b < n and (low[b].isalnum() or low[b] in "_@-")):
            continue
        if title:
            m = AFTER_TITLE.match(text, b)
            if m and (m[2][0].isupper() or text.islower()) and m[2].lower() not in NOT_SURNAMES and m[2].lower() not in _GIVEN_SET:
                add("person_name", m.start(1), m.end())
            continue
        small = text[a].islower()
        back = _surname_before(text, a)
        if back is not None:
            word = text[back : text.index(",", back)]
            if not ((word[0].isupper() or small) and word.lower() not in NOT_BEFORE_COMMA and len(word) > 2):
                back = None
        if back is not None and CUE.search(text, max(0, back - 20), back):  # "Marsh, Ann" where a name is due
            add("person_name", back, b)
            continue
        m = AFTER_GIVEN.match(text, b)
        if m and len(m[1]) > 2 and m[1].lower() not in NOT_SURNAMES and (m[1][0].isupper() or small and len(m[1]) > 3):
            add("person_name", a, m.end())
        elif back is not None:
            add("person_name", back, b)
    if "." in text:
        for m in INITIAL_NAME.finditer(text):
            before = text[max(0, m.start() - 20) : m.start()]
            if (m[1][0].isupper() and len(m[1]) > 2) and not re.search(r"[\d-][A-Za-z]?[ \xa0]$", before) and not re.match(r"[ \xa0]+(?:%s)\b" % STREETS, text[m.end() :], re.I) and CUE.search(before) and m[1].lower() != "box":
                add("person_name", m.start(), m.end())


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in text as stored, without overlaps."""
    if not text:
        return []
    form, places = plain_form(text)
    low = form.lower() if len(form.lower()) == len(form) else "".join(c.lower() if len(c.lower()) == 1 else c for c in form)
    spans: list[tuple[int, int, int, str]] = []
    add = lambda kind, a, b, rank=1: spans.append((rank, a, b, kind))
    if "@" in form:
        for m in EMAIL.finditer(form):
            add("email", m.start() + (7 if m.group().lower().startswith("mailto:") else 0), m.end(), 0)
    for m in SSN.finditer(form):
        if not _of_something_else(form, m.start()):
            add("id_number", m.start(), m.end(), 0)
    if "ssn" in low or "social" in low:
        for m in NINE.finditer(form):
            add("id_number", m.start(1), m.end(1), 0)
    for m in NATIONAL.finditer(form):
        if p := NATIONAL_PREFIX.search(form, max(0, m.start() - 4), m.start()):
            add("id_number", p.start(), m.end(), 0)
    if "licen" in low or "passport" in low or "dl#" in low or "dl " in low or "dl:" in low:
        for m in LICENCE.finditer(form):
            add("id_number", m.start(1), m.end(1), 0)
    whole_case = not any(c.isupper() for c in form) or not any(c.islower() for c in form)
    for m in ADDRESS.finditer(form):
        words = re.findall(r"[^\W\d_][\w'-]+", m.group())
        if whole_case or words[0][0].isupper() or words[0].lower() in ("county", "state", "rural") or len(words[0]) > 3 and words[-1].lower() not in ("way", "place", "court", "drive", "row", "square"):
            if len(words) <= 2 or words[0][0].isupper() or whole_case:
                add("address", m.start(), m.end())
    if "box" in low:
        for m in PO_BOX.finditer(form):
            add("address", m.start(), m.end())
    if any(w in low for w in FOREIGN_STREETS):
        for m in STREET_FIRST.finditer(form):
            add("address", m.start(), m.end())
    if any(w in low for w in LONG_STREETS):
        for m in WORD_ADDRESS.finditer(form):
            if re.search(r"[A-Z][\w'-]+[ \xa0]+(?:%s)\b" % STREETS.replace("|", "|"), m.group(), re.I) and (whole_case or re.search(r"[ \xa0][A-Z]", m.group())):
                add("address", m.start(), m.end(), 2)
    for m in PHONE.finditer(form):
        if not _of_something_else(form, m.start()):
            add("phone", m.start(), m.end(), 1)
    _names(form, low, lambda kind, a, b: add(kind, a, b, 3))
    _due_names(form, low, lambda kind, a, b: add(kind, a, b, 4))
    spans.sort(key=lambda s: (s[0], s[1], -s[2]))
    taken: list[tuple[int, int, str]] = []
    for _, of in groupby(spans, key=lambda s: s[0]):  # the spans of a rank are swept together with those taken before
        k, kept, end = 0, [], 0
        for _, a, b, kind in of:
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if a >= end and (k == len(taken) or b <= taken[k][0]):
                kept.append((a, b, kind))
                end = b
        taken = sorted(taken + kept)
    if places is not None:
        taken = [(places[a], places[b - 1] + 1 if b - 1 < len(places) else places[-1], kind) for a, b, kind in taken]
    return sorted(taken)


def redact(text: str | None) -> str | None:
    """text with each piece of personal data replaced by its placeholder."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find_spans(text):
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, kinds, starts, ends = [], [], [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            for a, b, kind in find_spans(text):
                rows.append(k)
                kinds.append(kind)
                starts.append(a)
                ends.append(b)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["id", "kind", "start_pos", "end_pos"])


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([redact(t) for t in batch.column(1).to_pylist()], pa.string())], ["id", "text"])


def find_personal_data(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, start_pos, end_pos) of each piece; positions count characters from 0 in the text as stored.

    Null, blank and empty texts have none. A repeated id with the same text counts once. Whole
    texts are read, however long; the work is in proportion to them. Other columns are ignored.
    """
    kind = texts.select(id_col).dtypes[0][1]
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(_found, f"id {kind}, kind string, start_pos int, end_pos int").distinct()


def redact_texts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with personal data replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME]; null stays null."""
    kind = texts.select(id_col).dtypes[0][1]
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_redacted, f"id {kind}, text string")
