"""The tagger outside what it was trained on: unseen wordings, names in no list, and wordings that only resemble personal data."""

import random
import re

import pytest

from quaysift.llm import pii
from quaysift.llm import pii_templates as P

#: Wordings that training doesn't have.
UNSEEN = """
Could you forward this to {N} before Friday?
Our caretaker, {N}, found the door open.
Last week {N} bought two vans from us.
{N} was promoted to head of treasury.
The deposit was refunded to {N} in cash.
During the call, {N} mentioned a second offer.
Permission was granted by {N} in writing.
Nobody had heard from {N} since the closing dinner.
The letter is addressed to {N} and was returned.
Witnessed by {N} in the presence of {N}.
Meeting with {N} moved to Tuesday.
If you see {N}, say hello.
A share of two percent goes to {N} for life.
The dispute between {N} and {N} was settled.
{N} joined the call late and left early.
Forwarded message from {E}
Invoices should be mailed to {E} by the end of the month.
You can unsubscribe by writing to {E}.
Username: {E}
We have two addresses on record: {E} and {E}.
The reply came from {E}, not from the bank.
After hours, dial {P} and wait for the tone.
His mobile ({P}) is switched off.
The plumber can be called on {P} at any time.
Text {P} to confirm the visit.
Tel.: {P}
Her office line is {P}, extension unknown.
Copy of passport no. {I} attached.
Borrower’s social security number: {I}.
She quoted her NI number {I} over the phone.
Identity verified by driving licence {I}.
For tax purposes his tax ID is {I}.
National ID {I} was read from the card.
The house at {A} was sold last spring.
Please send the keys to {A}.
They rent a flat at {A}.
Home: {A}
The parcel was left at {A} by mistake.
Her late uncle lived at {A} until 2010.
""".strip().split("\n")
#: Names of which no part is in the training lists.
FULL = [
    "Harriet Blackwood", "Desmond Achebe", "Ljubica Marković", "Thorvald Eriksen", "Giovanna Lombardi", "Mei-Ling Zhou", "Arjun Venkataraman", "Solveig Nygård", "Mr Pemberton", "Dr. Castellanos", "Maria de la Cruz", "Ludwig van Beek",
    "Jiří Konečný", "Łukasz Wójcik", "Ms Ferrari-Holt", "K. Abernathy", "Valentina R. Sforza", "Mrs Okonkwo", "Étienne Beaumont", "Håkon Solberg", "Roderick Quill", "Prof. Steinmetz", "Isabel Montoya", "Gareth Llewellyn",
]
UNSEEN_DECOYS = """
Blackwood Ferrari LLP lost the appeal.
The Castle Road warehouse is empty.
Delivery note 4500123456 is missing.
Project Blue Heron starts in April.
Company number 07654321 was struck off.
The Regional Sales Director met the Works Council.
Free Cash Flow for Q4 2023 was $12.4 million.
The Hamburg office and the Rotterdam terminal share one lease.
Account number 12345678 at Northern Trust Bank
Invoice 2023-00417 was paid on 2023-05-06.
Gross Margin rose to 41.5 percent in FY2024.
Clause 12 Closing Conditions, Annex 4 Warranties
The Annual General Meeting is on 14 May 2024.
Silverline Polymers GmbH owns Redwater Foods plc.
Plot 14/220 north of the mill
""".strip().split("\n")


def unseen(seed: int):
    rng = random.Random(seed)
    for template in UNSEEN:
        for _ in range(12):
            text, want = "", []
            for part in re.split(r"(\{\w\})", template):
                key = part[1:-1] if part.startswith("{") else None
                if key:
                    value = rng.choice(FULL) if key == "N" else P.VALUE[key](rng)
                    want.append((len(text), len(text) + len(value), P.KINDS[P.KIND[key]]))
                    text += value
                else:
                    text += part
            yield text, want


def test_unseen_wordings():
    cases = list(unseen(11))
    found = pii.find([text for text, _ in cases])
    hit, total, wrong, missed = dict.fromkeys(P.KINDS, 0), dict.fromkeys(P.KINDS, 0), 0, []
    for (text, want), got in zip(cases, found):
        for a, b, kind in want:
            total[kind] += 1
            covered = any(k == kind and s < b and e > a for s, e, k in got)
            hit[kind] += covered
            if not covered:
                missed.append((kind, text))
        wrong += sum(not any(s < b and e > a for a, b, _ in want) for s, e, _ in got)
    print(hit, total, wrong, *missed[:40], sep="\n")
    for kind in P.KINDS:
        assert hit[kind] / total[kind] >= 0.9, (kind, hit, total)
    assert wrong <= 0.05 * len(cases)


def test_every_form_has_a_cue():
    """A value of any kind, in any wording, lies within the stretches which the tagger reads."""
    rng = random.Random(5)
    for template in P.TEMPLATES + UNSEEN:
        for _ in range(6):
            text, spans = P.sentence(template, rng)
            read = pii.stretches(text)
            for a, b, k in spans:
                if P.KINDS[k] == "phone" and sum(c.isdigit() for c in text[a:b]) < 7:
                    continue
                assert any(s < b and e > a for s, e in read), (text, text[a:b])


def test_decoys():
    wrong = [(t, f) for t, f in zip(UNSEEN_DECOYS, pii.find(UNSEEN_DECOYS)) if f]
    assert len(wrong) <= 2, wrong


@pytest.mark.parametrize(("text", "kinds"), [
    ("Please call John Smith on +44 20 7946 0958 today.", {"person_name", "phone"}), ("My SSN is 123-45-6789.", {"id_number"}), ("Passport no. 533380006", {"id_number"}), ("NI number QQ 12 34 56 C", {"id_number"}),
    ("Tax ID 98-7654321", {"id_number"}), ("Yesterday Maria de la Cruz called our office.", {"person_name"}), ("My neighbour Jiří\xa0Novák has moved.", {"person_name"}),
])
def test_plain_cases(text, kinds):
    assert {k for *_, k in pii.find([text])[0]} == kinds


def test_every_position_is_read():
    """All of a text passes the tagger, whether or not it has a cue; what only a cue let be read before is found."""
    seen = []

    class Spy(pii.Tagger):
        def scores(self, x, lengths):
            seen.extend("".join(map(chr, row[:n])) for row, n in zip(x.tolist(), lengths.tolist()))
            return super().scores(x, lengths)

    with pii.np.load(pii.WEIGHTS) as f:
        spy = Spy(dict(f))
    for text in ("nothing here is in capitals, no sign and no number. " * 9, "short", "ab" * 7000):
        seen.clear()
        pii.find([text], spy)
        whole = "".join(map(chr, pii.codes(text).tolist()))
        assert seen and all(any(whole[a : a + 5] in w for w in seen) for a in range(0, len(whole) - 4, 3)) and sum(map(len, seen)) >= len(text)


@pytest.mark.parametrize("text", ["please call 020–7946–0958 today.", "his number is +44–20–7946–0958.", "reach him at 555_867_5309 any time"])
def test_found_without_cue(text):
    assert pii.find([text])[0] and not pii.stretches(text)


def test_pieces_decode_as_whole_texts():
    """Texts are decoded in short pieces between positions that no span can cover, with the paths of whole texts."""
    np, net = pii.np, pii.tagger()
    filler = "The margin of the second quarter was lower than that of the first, as freight and energy cost more than planned.\n"
    texts = [filler * 6 + text + " " + filler * 5 for text, _ in list(unseen(3))[::24]] + ["short", "Mr Pemberton"]
    scores, decoded = [], pii._decoded

    def spy(flat, ends, net):
        scores.extend(np.split(flat.copy(), ends[:-1]))
        return decoded(flat, ends, net)

    pii._decoded = spy
    try:
        tags = pii._tag_texts([pii.codes(t) for t in texts], net)
    finally:
        pii._decoded = decoded
    assert all((a == b).all() for a, b in zip(tags, net.decode(scores), strict=True)) and sum(t.any() for t in tags) > 15
    plain = pii._plain(np.concatenate(scores), net.trans)
    assert plain.mean() > 0.2 and not np.concatenate(tags)[plain].any()
