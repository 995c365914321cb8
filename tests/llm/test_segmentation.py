"""Sentence units of texts marked by hand: '|' stands between units and isn't part of the text."""

import pytest

from rillframe.llm.segmentation import cascade, languages, sentence_units, sentences, usual

CASES = [
    ("en", "Dr. Brunnick saw Fig. 7 (cf. Sec. 2.1).| Nothing else changed."),
    ("en", "Session 782 ended at 4 p.m.| What a mess…| The cap came loose, roughly 23 min. into the take."),
    ("en", "nobody touched v4.6.11.| 5 of 41 takes failed.| left.mp4 is fine.| recording.json\nis older."),
    ("en", '"Stop. Put the drawer down," said the operator.| He asked: "Who moved it?"| Open audio.mka.'),
    ("en", "Please re-run it 🙂| Why did it stop at row 12,889?!| (The cap had been swapped.)| Wow!"),
    ("en", "J. Brunnick and K. Mendrake came, i.e. Vaelin left.| The mount went quiet... then it worked for 8 s.| J. Ortvane left."),
    ("en", 'She wrote "see p. 4" next to chunk 21.| The track says "new segment!" twice at 9.9 s.| Bring tape, etc.| Take No. 42 is odd.'),
    ("de", "In audio.mka fehlen z. B. die Zeilen 74 bis 238.| Nach 45 Sekunden fiel die Rate usw.| Wurde die 8. Aufnahme geschnitten?"),
    ("de", "Dr. Irvoth hat am 3. Juli kalibriert.| Siehe Abb. 9 und Abschn. 7.7, d. h. Kapitel drei.| „Halt! Nicht anfassen“, rief jemand."),
    ("de", "Prof. Kelmark fragte: „Wer hat den Deckel bewegt?“| Das Brett war nach 32 Min. wieder locker."),
    ("es", "«Corta aquí. Ahora otra vez», dijo Irvoth.| ¿Quién movió la caja a las 8 p. m.?| ¡No toques la lente!| La Dra. Kelmark midió 0,82 m, p. ej. desde la pared."),
    ("es", "El Sr. Kelmark preguntó: «¿Seguimos?»| La toma núm. 6 ocupa 3 GB, etc.| Informe n.º 52 falta."),
    ("zh", "操作员说：“停！先别动抽屉。”|谁换了标定板？|“慢一点？”同事问。|固件v3.9已装好！|口令只识别出5次……后来好了。"),
    ("ja", "「止めて。箱を置いて」と担当者が言った。|9秒の所で「録画を停止！」と聞こえます。|版はv4.2.8、確認者は木羽です。| 倉庫では音がひどい！"),
    ("hi", "डॉ. Brunnick ने रिग 8 दोबारा जाँचा।| क्या audio.mka पूरी है?| तार को मत छुओ!"),
    ("ar", "د. Mendrake قاس المسافة 2.77 متر.| هل تحرك الحامل؟| الجهاز رقم 8 فقد 114 إطارا؛ والباقي سليم."),
    ("th", "กล้องซ้ายหยุดหลังจาก 63 นาทีแล้ว| ระยะห่างคือ 2.62 เมตรจากผนัง| ห้องครัวเสียงดังเกินไป"),
    (None, "谁换了标定板？| What a mess…|The filter flickered.| 固件v1.1已装好！|The fold took 3 s."),
    ("en", "no final mark here\n\n|A Heading\n\n|one line\nwrapped over two"),
    ("en", "the first is lower case.| so is the second?| yes.\n\n|But 5 min. here are not."),
    ("en", "The lens froze at 4 p.m.| J. Vaelin came.|The rest was fine!|«Quite so.»| Dr.Irvoth left."),
    ("en", "We raised the gain to the max.| Then we stopped.| He kept an open mind.| Then he left."),
    ("en", "It was modern art.| 5 people came.| Use the cap.| 3 cables are left."),
    ("en", "Acme Corp. Ltd. is here.| U.S. Army units moved.| He works at Acme Inc.| Then he left for the U.S.| It was late."),
    ("de", "Das ist mind. 5 m lang.| Es dauert max. 3 Tage."),
    ("fr", "M. Dupont a vu la fig. 3 dans le livre.| Il est parti, p. ex. hier."),
    ("it", "Il Sig. Rossi è a pag. 4 con gli altri.| Poi è uscito."),
    ("pt", "O Sr. Silva não viu a pág. 4.| Depois saiu."),
    ("ru", "Это на рис. 4.| Потом проф. Иванов ушёл."),
    ("en", "Mixed: it was “done. Really” they say.| Next."),
]


def split(marked):
    text, at, spans, begin = marked.replace("|", ""), 0, [], 0
    for part in marked.split("|"):
        body = part.strip()
        lead = len(part) - len(part.lstrip())
        if body:
            spans.append((at + lead, at + lead + len(body)))
        at += len(part)
    return text, spans


@pytest.mark.parametrize(("lang", "marked"), CASES)
def test_marked(lang, marked):
    text, spans = split(marked)
    assert sentences(text, lang) == spans
    assert sentences(text, None) == spans


def units(text):
    return [text[a:b] for a, b in sentences(text)]


def test_lists():
    assert units("Todo:\n- first\n- second\n  on two lines\n\n1) one\n2) two") == ["Todo:", "first", "second\n  on two lines", "one", "two"]
    assert units("Wurde die\n8. Aufnahme schon geschnitten?") == ["Wurde die\n8. Aufnahme schon geschnitten?"]
    assert units("  • derived/x.npz is bad.\n• Next one. And more.") == ["derived/x.npz is bad.", "Next one.", "And more."]


@pytest.mark.parametrize("length", [20, 290, 5_000, 50_000])
@pytest.mark.parametrize("marks", ["“”", '""', "„“", "«»"])
def test_quotations_of_any_length(length, marks):
    half = "So it goes. " * (length // 12) + "Yes"
    text = f"He said: {marks[0]}{half}. {half}{marks[1]}, and left. Then he came."
    assert units(text) == [text[: -len(" Then he came.")], "Then he came."]


def test_unclosed_quotations_end_nothing_and_hide_nothing():
    assert units("He said “so. Then he left. “Yes,” she said. No.") == ["He said “so.", "Then he left.", "“Yes,” she said.", "No."]


def test_the_usual_end_is_what_the_tables_say():
    """Positions that are parted without asking the tables are those that these part."""
    names = ["Mr", "mind", "art", "fig", "seen", "x", "pág", "ended", "ca", "4", "über", "etc"]
    for lang in ("en", "de", "es", None):
        for name in names:
            for mark in (".", "?", "!", "..", "?!"):
                for gap in (" ", "\n", "  ", ""):
                    block = f"We saw {name}{mark}{gap}The rest"
                    at = len("We saw ") + len(name) + len(mark)
                    if usual(block, mark, at):
                        for pattern, does in cascade(languages(block, lang), False):
                            if (rule := pattern.match(block, at)) is not None:
                                assert does[rule.lastindex]
                                break
                        else:
                            raise AssertionError(block)


def test_edges():
    assert sentences(None) == [] and sentences("") == [] and sentences(" \n\t\n ") == []
    assert units("...") == ["..."] and units("!\n\n?") == ["!", "?"]
    assert units("a" * 200_000) == ["a" * 200_000]
    long = "One sentence here. " * 20_000
    assert len(sentences(long)) == 20_000
    assert units("\r\nA b.\r\n\r\nC d.\r\n") == ["A b.", "C d."]


def test_units_cover_all_but_space():
    text = "Ab cd.  Ef!\n\n 「あ。い」と。う？ x"
    held = set().union(*(range(a, b) for a, b in sentences(text)))
    assert all(k in held or text[k].isspace() for k in range(len(text)))


def test_table(spark):
    df = spark.createDataFrame([(1, "Ab 😀. Cd.", "en", 5), (2, None, None, 5), (3, "", "xx", 5), (1, "Ab 😀. Cd.", "en", 5), (None, "Z.", None, 5)], "doc_id long, text string, lang string, start int")
    out = sentence_units(df, doc_id="doc_id", text="text", lang="lang")
    got = sorted((r["doc_id"] or 0, r["start"], r["end"], r["unit"]) for r in out.collect())
    assert got == [(0, 0, 2, "Z."), (1, 0, 5, "Ab 😀."), (1, 0, 5, "Ab 😀."), (1, 6, 9, "Cd."), (1, 6, 9, "Cd.")]
    bare = sentence_units(df, doc_id="doc_id", text="text", lang="lang", unit=False)
    assert bare.columns == ["doc_id", "start", "end"] and sorted((r["doc_id"] or 0, r["start"], r["end"]) for r in bare.collect()) == [r[:3] for r in got]
    assert sentence_units(df.limit(0), doc_id="doc_id", text="text").count() == 0
