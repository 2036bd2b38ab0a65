"""Identifiers that bootstrapping adds to the base spans, and those it must leave alone."""

from incognita.llm import pii


def added(spark, texts):
    rows = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    return {(r.doc_id, texts[r.doc_id][s.start : s.end]) for r in rows for s in r.spans if s.kind == pii.FOUND}


def planted():
    """Texts, and the identifiers in them that no base pattern finds but whose contexts hold seeds elsewhere."""
    texts, wanted = [], set()
    for i in range(40):
        texts.append(f"the account of card 45320151128{i:02d}{'0'} was closed, write to user{i}@mail.example.com for more")
    for i in range(8):
        texts.append(f"please write to user{i + 50}@mail.example.com today")
        texts.append(f"and then token = \"{'0a1b2c3d4e' * 3}{i:02d}\"; the rest follows")
    for i, own in enumerate(["jane.roe@localhost", "k7-442", "ops@intranet"]):
        texts.append(f"or write to {own}, if you must")
        wanted.add((len(texts) - 1, own))
    texts.append("there token = 'x99', as before")
    wanted.add((len(texts) - 1, "x99"))
    return texts, wanted


def test_planted_identifiers(spark):
    texts, wanted = planted()
    found = added(spark, texts)
    keys = {(i, t[t.index('"') + 1 : t.rindex('"')]) for i, t in enumerate(texts) if "token" in t and '"' in t}
    assert len(keys) == 8 and wanted <= found, "recall 1.0"
    assert found == wanted | keys, "precision 1.0"


def test_poor_patterns_add_nothing(spark):
    """A pattern of few seeds, one that numbers follow more often, and a digest that no pattern holds."""
    texts = [f"reach him at user{i}@mail.example.com now" for i in range(4)] + ["reach him at desk7 now"]
    texts += [f"{'so' * i} born in 19{i:02d}" for i in range(30)] + [f"{'no' * i} born in {i}.2.3.4" for i in range(1, 8)]
    texts += ["the sum of it is 0a1b2c3d4e0a1b2c3d4e0a1b2c3d4e"]
    assert added(spark, texts) == set()


def test_words_on_both_sides(spark):
    """The words before differ, those next to the token agree."""
    texts = [f"w{'x' * i} mail user{i}@mail.example.com (private) end" for i in range(6)] + ["quite another mail bob@home (private) end"]
    texts += ["yet another mail 77 (public) end", "mail 8", None, "", "@", "mail @ (private)"]
    assert added(spark, texts) == {(6, "bob@home")}
