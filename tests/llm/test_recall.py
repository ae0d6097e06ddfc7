"""Recall and precision of licence labels and of personal data on rows planted in the given documents."""

import random

from plinth.llm import license, pii

SF = "/root/testdata/sf0.001"


def clean_texts(spark):
    """Texts of the given documents without a licence's or personal data's own words."""
    rows = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r["text"]]
    return [t for t in rows if not any(w in t.lower() for w in ("licen", "cc by", "@", "+", "key", "token", "password", "public domain", "permission")) and not any(c.isdigit() for c in t)]


def test_licence_labels_of_planted_wordings(spark):
    """Every wording whole, in another case and layout, and with one word in fifteen changed; clean texts get no label."""
    rng, texts = random.Random(4), clean_texts(spark)
    assert len(texts) > 40
    rows, want = [], {}
    for label, wording in license.TEMPLATES:
        words = wording.split()
        changed = [w if i % 15 != 7 else "other" for i, w in enumerate(words)]
        forms = [wording, "\n * ".join([" ".join(words[i : i + 6]).upper() for i in range(0, len(words), 6)])]
        if len(words) >= 15:
            forms.append(" ".join(changed))
        for form in forms:
            before, after = rng.choice(texts), rng.choice(texts)
            want[len(rows)] = label
            rows.append((len(rows), f"{before}\n\n{form}\n\n{after}"))
    clean = range(len(rows), len(rows) + len(texts))
    rows += [(i, t) for i, t in zip(clean, texts)]
    got = {r["doc_id"]: r for r in license.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = [i for i, label in want.items() if label in got[i]["labels"].split(",")]
    assert len(hit) >= 0.95 * len(want), [(want[i], rows[i][1][:0]) for i in want if i not in hit]
    # What an added label covers is the wording, but for a word or two at its ends.
    assert not [i for i in clean if got[i]["labels"]]


def luhn(digits):
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1]))
    return digits + [-total % 10]


def iban(rng):
    body = "".join(str(rng.randrange(10)) for _ in range(18))
    check = 98 - int(body + "131400") % 97
    return f"DE{check:02}{body}"


def test_personal_data_of_planted_rows(spark):
    """Values of each kind after words that a writer would put there, and the same documents without them."""
    rng, texts = random.Random(5), clean_texts(spark)
    digits = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    card = lambda: "".join(map(str, luhn([4] + [rng.randrange(10) for _ in range(14)])))
    grouped = lambda c: " ".join(c[i : i + 4] for i in range(0, len(c), 4))
    makers = {
        "email": ("write to ", lambda: f"jo.{digits(3)}+x@mail-{digits(2)}.example.org"), "ip": ("the server at ", lambda: ".".join(str(rng.randrange(256)) for _ in range(4))),
        "card": ("paid by card ", lambda: rng.choice([card(), grouped(card())])), "phone": ("call ", lambda: f"+{rng.randrange(1, 99)} {digits(3)} {digits(7)}"),
        "iban": ("to the account ", lambda: rng.choice([str, grouped])(iban(rng))), "ssn": ("social security number ", lambda: f"{rng.randrange(100, 666)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"),
        "local_phone": ("phone ", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"), "ipv6": ("the host ", lambda: ":".join(f"{rng.randrange(1, 65536):x}" for _ in range(8))),
        "secret": ("", lambda: f"api_key = {digits(4)}abcDEF{digits(6)}"), "key": ("with the token ", lambda: "ghp_" + "".join(rng.choice("abcdefXYZ0123456789") for _ in range(36))),
    }
    rows, want = [], {}
    for kind, (lead, make) in makers.items():
        for _ in range(25):
            before, after, value = rng.choice(texts), rng.choice(texts), make()
            start = len(before) + 2 + len(lead)
            want[len(rows)] = f"{kind}:{start}:{start + len(value)}"
            rows.append((len(rows), f"{before}, {lead}{value} , {after}"))
    clean = range(len(rows), len(rows) + len(texts))
    rows += [(i, t) for i, t in zip(clean, texts)]
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    found = {kind: sum(want[i] in got[i] for i in want if want[i].startswith(kind + ":")) for kind in makers}
    assert all(n >= 24 for n in found.values()), found
    assert not [i for i in clean if got[i] != [""]]
