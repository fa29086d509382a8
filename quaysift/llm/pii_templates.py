"""Labelled sentences for training the tagger: own templates around generated values, in several languages and layouts.

Values come from rules: syllables and word lists for names, digit patterns for numbers, street forms for addresses. Half of
the sentences hold personal data; the others hold what resembles it (law firms, invoices, parcels, projects, places).
"""

from __future__ import annotations

import random
import re
import string

KINDS = ("person_name", "email", "phone", "id_number", "street_address")

# Given and family names of several languages.
GIVEN = (
    "Anna Maria John James Robert Mary Patricia Linda Michael David Sarah Emily Olivia Lucas Jan Piotr Katarzyna Agnieszka Łukasz Jiří Tomáš Zdeněk Eva Hana Björn Åsa Søren Mette Lars Ingrid Jürgen Günther Käthe Friedrich "
    "Sabine Heinz Ulrike Pierre Jean Marie Élodie François Benoît Chloé Thérèse José Carmen Lucía Íñigo Álvaro Pilar Inês João Tiago Beatriz Giulia Marco Luca Chiara Alessandro Willem Pieter Anneke Joost Dmitri Olga Irina "
    "Sergei Natalia Yusuf Ayşe Mehmet Fatima Ahmed Omar Layla Priya Rajesh Anil Sunita Wei Ming Hiroshi Yuki Kenji Minh Thu Kwame Amara Chidi Noor Rafe Greta Ilse Teodor Rene Callum Yara Nia Seán Siobhán Owen Bronwyn"
).split()
FAMILY = (
    "Smith Jones Brown Taylor Wilson Johnson Williams Miller Davis Walker Wright O'Neil O’Connor McDonald MacKay Fitzgerald Müller Schmidt Schneider Weiß Köhler Böhm Groß Novák Svoboda Dvořák Žak Kowalski Wiśniewska Nowak "
    "Zieliński Andersson Lindström Östberg Hansen Sørensen Bjørnstad Dubois Lefèvre Moreau Girard Bélanger García Fernández Núñez Ibáñez Ortega Silva Gonçalves Araújo Pereira Rossi Bianchi Esposito D’Angelo Conti Jansen Bakker "
    "Visser Ivanov Petrova Sokolov Yılmaz Demir Öztürk Hassan Rahman Khan Patel Sharma Gupta Chen Wang Nakamura Tanaka Nguyễn Tran Okafor Mensah Adeyemi Cohen Levi Beldane Cranwick Torley Fenwick Hargreaves Lovelace Penrose Whitcombe"
).split()
PARTICLES = ("de", "de la", "van", "van der", "von", "di", "da", "dos", "del", "bin", "ter", "Le", "von der")
STREETS = "High Station Church Park Victoria Mill Green King Queen School North South Elm Oak Maple Cedar Chestnut Harbour Bridge Abbey Castle Kestrel Larch Market".split()
TOWNS = "Leeds Bristol Norwich Dublin Utrecht Leipzig Lyon Porto Gdynia Brno Turin Oslo Malmö Köln Springfield Portland Madison Riverton Fairview Newhaven Saltmere Ardle Eastham".split()
COMPANIES = "Vangate Harrow Meridian Northgate Calder Brightwater Ashdown Larkspur Kestrel Orchard Foundry Granite Beacon Halcyon Lantern Juniper Cobbler Tannery Quarry Heron".split()
SECTORS = "Logistics Foods Textiles Robotics Software Marine Dairy Energy Packaging Optics Ceramics Freight Polymers Diagnostics Instruments Coatings".split()

_CONSONANTS, _VOWELS = "bcdfghjklmnprstvwz", "aeiouyéöáü"


def _made(rng: random.Random) -> str:
    """An invented word: the head of one listed name with the tail of another, or syllables."""
    if rng.random() < 0.5:
        names = GIVEN if rng.random() < 0.5 else FAMILY
        a, b = rng.choice(names), rng.choice(names).lower()
        word = a[: rng.randint(2, max(2, len(a) - 1))] + b[-rng.randint(2, 4) :]
        return word if word.isalpha() else a
    parts = [rng.choice(_CONSONANTS + "  ").strip() + rng.choice(_VOWELS) + rng.choice(["", "", "n", "r", "l", "s", "ck", "st", "sky", "ø"]) for _ in range(rng.randint(2, 3))]
    return "".join(parts).capitalize()


def _digits(rng: random.Random, pattern: str) -> str:
    """0 becomes a digit, A a capital, anything else stays."""
    return "".join(rng.choice(string.digits) if c == "0" else rng.choice(string.ascii_uppercase) if c == "A" else c for c in pattern)


def name(rng: random.Random) -> str:
    given = rng.choice(GIVEN) if rng.random() < 0.6 else _made(rng)
    family = rng.choice(FAMILY) if rng.random() < 0.5 else _made(rng)
    if rng.random() < 0.08:
        family += "-" + (rng.choice(FAMILY) if rng.random() < 0.5 else _made(rng))
    if rng.random() < 0.08:
        given += "-" + rng.choice(GIVEN)
    if rng.random() < 0.07:
        family = f"{rng.choice(PARTICLES)} {family}"
    how = rng.random()
    if how < 0.58:
        out = f"{given} {family}"
    elif how < 0.66:
        out = f"{given[0]}. {family}"
    elif how < 0.72:
        out = f"{given} {rng.choice(string.ascii_uppercase)}. {family}"
    elif how < 0.86:
        title = rng.choice(["Mr", "Mrs", "Ms", "Dr", "Prof", "Miss"]) + rng.choice(["", "", "."])
        out = f"{title} {family}" if rng.random() < 0.7 else f"{title} {given} {family}"
    elif how < 0.91:
        out = f"{family}, {given}" if rng.random() < 0.6 else f"{family}, {given[0]}."
    elif how < 0.95:
        out = f"{given} {rng.choice(GIVEN)} {family}"
    else:
        out = f"{given} {family}".upper()
    return out.replace(" ", " ", 1) if rng.random() < 0.02 else out


def _ascii(word: str) -> str:
    import unicodedata

    return re.sub(r"[^a-z]", "", unicodedata.normalize("NFKD", word.lower())) or "info"


def email(rng: random.Random) -> str:
    given, family = _ascii(rng.choice(GIVEN) if rng.random() < 0.5 else _made(rng)), _ascii(rng.choice(FAMILY) if rng.random() < 0.5 else _made(rng))
    user = rng.choice([f"{given}.{family}", f"{given[0]}{family}", f"{family}{rng.randint(1, 99)}", f"{given}_{family}", given, f"{given}+deal", f"{given}-{family}"])
    host = rng.choice([f"{_ascii(_made(rng))}", f"{_ascii(_made(rng))}-group", f"mail.{_ascii(_made(rng))}"])
    end = rng.choice(["com", "org", "example", "co.uk", "de", "fr", "test", "net", "io", "invalid"])
    out = f"{user}@{host}.{end}"
    if rng.random() < 0.18:
        at = rng.choice([" (at) ", "(at)", " [at] ", " @ ", "[at]"])
        out = f"{user}{at}{host}{rng.choice(['.', ' (dot) ', '[dot]', ' . '])}{end}"
    return out.upper() if rng.random() < 0.03 else out


# Forms of telephone and identity numbers.
PHONES = (
    "+44 20 7946 0000", "+44 7000 000000", "+44 (0)20 0000 0000", "020 7946 0000", "(020) 7946-0000", "01632 960000", "07700 900000", "0000 000 0000", "(000) 000-0000", "000-000-0000", "000.000.0000", "+1 000 000 0000", "+1-000-000-0000",
    "1 (000) 000-0000", "+49 30 0000000", "+49 (0)89 000000-00", "030/0000000", "+33 0 00 00 00 00", "00 00 00 00 00", "+34 900 000 000", "+39 06 0000 0000", "+31 20 000 0000", "+48 00 000 00 00", "+420 000 000 000", "+353 0 000 0000",
    "0049 40 0000000", "+46-8-000 00 00", "+45 00 00 00 00", "+351 200 000 000", "000 0000", "555-0000", "+91 00000 00000", "+81-3-0000-0000", "08 00 00 00 00",
)
IDS = (
    "000-00-0000", "000 00 0000", "AA 00 00 00 A", "AA000000A", "AA 000000 A", "000000000", "A00000000", "AA0000000", "00-0000000", "00000000A", "00000000-A", "000 000 000", "00 000 000 000", "00000000000", "000000/0000", "000-000-000 00",
    "0 00 00 00 000 000 00", "A0000000", "AAA000000", "AAA 000 000", "A-0000-00000", "00.000.000-0", "AAAAA000000AA0AA", "0000 0000 0000", "00/000/00000",
)
ID_LABELS = (
    "SSN", "SSN:", "social security number", "Social Security No.", "NI number", "national insurance no.", "passport", "passport no.", "Passport number", "Passport no:", "ID card", "identity card no.", "national ID", "ID number", "ID no.", "personal ID",
    "Tax ID", "tax ID", "personal tax number", "taxpayer no.", "driving licence", "driver's license", "driver licence no.", "Steuer-ID", "Personalausweis", "NIR", "DNI", "codice fiscale", "PESEL", "BSN", "residence permit", "visa no.",
)


def phone(rng: random.Random) -> str:
    out = _digits(rng, rng.choice(PHONES))
    return out + f" {rng.choice(['ext.', 'x', 'ext'])} {rng.randint(1, 9999)}" if rng.random() < 0.08 else out


def id_number(rng: random.Random) -> str:
    return _digits(rng, rng.choice(IDS))


def address(rng: random.Random) -> str:
    number = f"{rng.randint(1, 399)}{rng.choice(['', '', '', 'a', 'b'])}"
    street = rng.choice(STREETS) if rng.random() < 0.5 else _made(rng)
    town = rng.choice(TOWNS) if rng.random() < 0.6 else _made(rng)
    kind = rng.random()
    if kind < 0.5:
        end = rng.choice("Street St Road Rd Avenue Ave Lane Ln Drive Dr Way Close Court Terrace Boulevard Blvd Square Crescent Place Row Gardens".split())
        out = f"{number} {street} {end}{rng.choice(['', '', '.']) if len(end) < 4 else ''}"
        if rng.random() < 0.25:
            out = rng.choice([f"Flat {rng.randint(1, 40)}, {out}", f"Apt {rng.randint(1, 40)}, {out}", f"{out}, Suite {rng.randint(1, 900)}", f"Unit {rng.randint(1, 40)}, {out}", f"{out}, Apt. {rng.randint(1, 40)}"])
        if rng.random() < 0.7:
            out += rng.choice([", ", ", ", "\n", ","]) + town
            out += rng.choice(["", "", _digits(rng, ", AA 00000"), _digits(rng, " AA0 0AA"), _digits(rng, " 00000"), _digits(rng, ", A00 0AA")])
    elif kind < 0.7:
        out = f"{street}{rng.choice(['gasse', 'straße', 'strasse', 'weg', 'platz', 'allee', 'straat', 'laan'])} {number}"
        if rng.random() < 0.75:
            out += rng.choice([", ", "\n", ", "]) + _digits(rng, rng.choice(["00000", "0000", "0000 AA", "00000"])) + " " + town
    elif kind < 0.85:
        way = rng.choice(["rue de", "rue des", "rue du", "rue", "avenue de", "Rue", "boulevard"])
        out = f"{number}{rng.choice([',', '', ''])} {way} {street}" if rng.random() < 0.5 else f"{rng.choice(['Via', 'Calle', 'Rua', 'ul.', 'Avenida', 'via', 'Plaza', 'calle'])} {street} {number}"
        if rng.random() < 0.6:
            out += rng.choice([", ", "\n"]) + rng.choice([_digits(rng, "00000 "), _digits(rng, "00-000 "), ""]) + town
    else:
        out = f"{rng.choice(['PO Box', 'P.O. Box', 'P. O. Box', 'Post box', 'Postal Box', 'Postfach', 'Apartado', 'P.O. box', 'Boîte postale'])} {rng.randint(1, 9999)}"
        if rng.random() < 0.6:
            out += rng.choice([", ", "\n"]) + town
    return out


VALUE = {"N": name, "E": email, "P": phone, "I": id_number, "A": address}
KIND = {"N": 0, "E": 1, "P": 2, "I": 3, "A": 4}

#: Own wordings; {x} picks a filler, {N} and the like a labelled value.
TEMPLATES = """
Yesterday {N} phoned the {unit} about {thing}.
{N} has moved to {town} and left no forwarding number.
The {role}, {N}, resigned in {month}.
Our neighbour {N} saw nothing.
For details, write to {E} or ring {P}.
Reach {N} at {P}.
{N} ({P})
{N} <{E}>
From: {N} <{E}>
To: {N}; {N}
Sent by {N} on behalf of {company}.
The file names {N} as {role}.
{N} said that {thing} was late.
"We agreed on {thing}," {N} told the {unit}.
We met {N} and {N} in {town}.
I spoke with {N} last week.
{N}’s notes on {thing} are missing.
{N}, {role}, {company}
{role}: {N}
Contact: {N}, {P}, {E}
Signed, {N}
Yours sincerely,\\n{N}\\n{role}
Kind regards\\n{N}\\n{company}\\n{P}
Name: {N}\\nPhone: {P}\\nE-mail: {E}
Employee {N}, {L} {I}, started in {month}.
{L} {I} belongs to {N}.
My {L} is {I}.
The {L} on the form reads {I}.
{L}: {I}
Her {L} ({I}) was copied by mistake.
Applicant {N} holds {L} {I}.
The guarantor’s {L} {I} appears twice.
{N} was born in {town}; {L} {I}.
He lives at {A}.
She moved to {A} in {month}.
Deliver the papers to {N}, {A}.
Residential address: {A}
Address: {A}
The witness gave {A} as a home.
Post for {N} goes to {A}.
Keys are with {N} at {A}, says the {role}.
{N} of {A} owns the shares.
Mail sent to {E} came back.
Write to {E}.
{E}; {E}; {E}
My address is {E}, please confirm.
{N} asked us to copy {E} on it.
Call me on {P}.
Phone {P} after six.
Fax {P}, mobile {P}.
T: {P} | M: {P} | {E}
The number {P} was not answered.
Direct line {P}; ask for {N}.
{P} is the private number of {N}.
Reviewed by {N}, approved by {N}.
{N} chaired; apologies from {N}.
Present: {N}, {N}, {N}
{N} | {P} | {thing}
{N} | {L} | {I}
Interview with {N}, {month} 2023
The heirs of {N} sold {thing}.
A letter from {N} dated 3 {month} asks for {thing}.
In {month}, {N} paid {money} for {thing}.
{company} hired {N} as {role}.
{N} left {company} for {company}.
The loan of {money} to {N} is open.
Counsel for {N} objected.
{N} will step down, the {unit} said.
It was {N} who found {thing}.
With thanks to {N} for {thing}.
Director {N} and {role} {N} voted against.
cc {N}
@{N}: see {thing}
Herr {N} wohnt in {A}.
Frau {N} ist unter {P} zu erreichen.
M. {N} habite {A}.
Madame {N} a signé pour {company}.
El señor {N} llamó desde {P}.
La dott.ssa {N} risponde a {E}.
Pan {N} mieszka przy {A}.
De heer {N} belde over {thing}.
O senhor {N} mora em {A}.
Ansprechpartner: {N}, {E}
Le numéro de {N} est le {P}.
Payroll lists {N} with {L} {I} and {money}.
Bonus for {N}: {money}
{L} {I}
{L} {I} attached
{L} {I}
{L} {I}
see {L} {I}, copy enclosed
{P}
{A}
the caller left {P} as a number
Mobile: {P}, office: {P}
Visitor badge issued to {N} ({company}).
Emergency contact {N} {P}
{N}, born 1974, {L} {I}
The signature of {N} was forged, {N} testified.
Thank {N} for me.
Did {N} approve {thing}?
Neither {N} nor {N} replied to {E}.
According to {N} the {unit} was told in {month}.
{N} disagreed.
{N} confirmed {money}.
Asked about {thing}, {N} declined to comment.
{N} – {role} – {P}
[{N}] {thing}
Attn. {N}\\n{A}
{N}\\n{A}\\n{P}
""".strip().split("\n")
#: Wordings which hold no personal data but resemble it.
DECOYS = """
{company} and {company} LLP advised on {thing}.
{family} & {family} LLP drafted {thing}.
{family}, {family} and Partners act for the lenders.
The offices of {company} in {town} closed in {month}.
Project {word} was renamed Project {word} {word}.
Invoice {num} of {company} is open.
Company no. {num}
registered under number {num}
Account {num} was closed in {month}.
Order no. {num}, parcel {num}
Purchase order {num} was cancelled by the {unit}.
{metric} came to {amount}.
{metric} came to {amount}, subject to audit.
{metric} FY2021: {amount}
In Q3'23, {metric} came to {amount} pounds.
{metric} | 2024Q1 | {amount}
All figures USD mm. {metric} FY2022 {amount}
{metric} Trailing Twelve Months: {amount}
Next meeting on 14 May 2024 in {town}.
The {street} Road warehouse is let to {company}.
Article 7 General Terms, Schedule 3 Warranties
Parcel {num} on {street} Lane covers four acres.
The {street} Street depot handles {thing}.
{word} Court ruled on {thing} in {month}.
The {town} plant and the {town} depot merged.
Net Income and Free Cash Flow rose in Q3 2024.
Total Revenue FY2023: {money}
The Chief Financial Officer and the Head of Sales met the Audit Committee.
VAT number {num} of {company}
Policy {num} expired on 2023-04-17.
Reference {num} dated 2022-11-30
Lot {num} was sold for {money}.
{firm} {word} Holdings owns {word} Bank.
Bank of {town}, account {num}
Serial {num}, batch {num}
The Board Deck and the Information Memorandum differ.
Great Northern Railway, Lake {town}, Mount {word}
Section 12 Main Agreement, Article 5 Closing Date
On 14 March the {unit} approved {money}.
In 2021 Meridian paid 45 Million dollars.
Contract {num} with {company}; claim no. {num}
Series {num} notes, ISIN {num}
{word} Fund II and {word} Capital Partners invested {money}.
Docket {num}, case {num}
The tax adviser of {company} in {town} charged {money}.
Version 3.2.1 of {word} Suite, build {num}
Ticket {num} opened by the service desk
EIN of the company {num}
Unit prices rose to {money} in New {town}.
Room 12 North Wing; Gate 7 East Terminal
Model {num} of {word} Instruments
Deed of {word} Lane, folio {num}
""".strip().split("\n")
#: What stands before and behind a name or what resembles one; any two are joined.
BEFORE = """
Two days ago|This morning|On Monday|In {month}|Since then|So far|Later|By then|Apparently|Meanwhile|We asked|They paid|Nobody knew|He trusted|She replaced|Please thank|Please ask|I know|You may tell|It seems that|We hear that|The {unit} told|The {unit} sued
A copy went to|He works for|This was bought from|We waited for|It was signed by|The claim against|A call with|Papers of|A gift from|Talks among {N2} and|Together with|On behalf of|Thanks to|The estate of|A proposal by|Cash from|The opinion of|In the view of|Next to|Without|Unlike
The {role}|Our {role},|Their {role}|As {role},|"|(|–|* |1. |- |Re: |Note: |Speaker: |Author: |Owner: |Q: |A: |Dear |Hello |and |or |that |while |because |where |although |whether |when |once |until |then |also |even |only
""".strip().replace("\n", "|").split("|")
BEHIND = """
 agreed at once.| was not there.| has left the company.| will pay {money}.| had asked for {thing}.| signed in {month}.| lives nearby.| owns a third of it.| and the {unit} met.| is ill.| came too late.| denied it.| sold {thing}.| in {town}.| about {thing}.| for {money}.
 last {month}.| again.|, who lives in {town}, agreed.|, the {role}, agreed.|, {role}| (absent)| – absent|: no comment.|; {thing}|.|,|?|!|"|)|\n|| on {thing}| with {N2}.| or {N2}.| against {N2}.| since 2019.| at home.| by phone.| joined us.| can sign.| must answer.| never replied.
""".strip("\n").replace("\n |", "\n|").split("|")
ROLES = "chief executive;finance director;site manager;Managing Director;plant lead;Head of Sales;auditor;treasurer;company secretary;caretaker;case officer;operations manager".split(";")
UNITS = "board;audit committee;bank;sales team;tax office;lender group;council;works council;finance team;clinic".split(";")
THINGS = "the lease;a missing pallet;the invoice;working capital;the Board Deck;the signed minutes;churn in Q2 2024;the pension;an unpaid bill;Net Income;the audit;Project Larkspur;the 2023 budget".split(";")
METRICS = "Revenue;Net Income;ARR;Recurring revenue (annualised);Adjusted EBITDA;Gross profit margin;Weight shipped;Tank capacity;Free Cash Flow;Headcount;Floor Area;Total Revenues".split(";")
MONTHS = "January February March April May June July August September October November December".split()
NUMBERS = ("00000000", "AA000000", "0000-0000", "0000000000", "00-0000000", "AA 000 0000 00", "000-00-0000", "00/000", "A-00000", "0000/00", "000000", "AA00 0000 0000 0000", "000 000 000", "0000-00-00")


def _filler(what: str, rng: random.Random) -> str:
    pick = {
        "role": ROLES, "metric": METRICS, "firm": COMPANIES, "unit": UNITS, "thing": THINGS, "month": MONTHS, "street": STREETS, "family": FAMILY,
    }
    if what in pick:
        return rng.choice(pick[what])
    if what == "town":
        return rng.choice(TOWNS) if rng.random() < 0.6 else _made(rng)
    if what == "word":
        return rng.choice(COMPANIES) if rng.random() < 0.6 else _made(rng)
    if what == "num":
        return _digits(rng, rng.choice(NUMBERS))
    if what == "money":
        return rng.choice(["$", "€", "£", "USD "]) + rng.choice([f"{rng.randint(1, 900)},{rng.randint(0, 999):03d}", f"{rng.randint(1, 99)}.{rng.randint(0, 9)}M", f"{rng.randint(1, 999)}K"])
    if what == "amount":
        whole = rng.randint(10 ** rng.randint(2, 6), 10 ** rng.randint(7, 9))
        return rng.choice([str(whole), f"{whole:,}", f"{whole:,}".replace(",", " "), f"{whole / 1e6:.1f}", f"{whole:,}".replace(",", "."), f"USD {whole}", f"{rng.random():.3f}"])
    if what == "L":
        return rng.choice(ID_LABELS)
    head = rng.choice(COMPANIES) if rng.random() < 0.4 else _made(rng)
    return f"{head} {rng.choice(SECTORS)}" + rng.choice(["", "", " Ltd", " GmbH", " Inc", " plc", " Holdings"])


def sentence(template: str, rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A filled template and its labelled spans (start, end, number of the kind)."""
    text, spans = "", []
    for part in re.split(r"(\{\w+\})", template.replace("\\n", "\n")):
        key = part[1:-1] if part.startswith("{") else None
        if key in VALUE:
            value = VALUE[key](rng)
            spans.append((len(text), len(text) + len(value), KIND[key]))
            text += value
        else:
            text += part if key is None else _filler(key, rng)
    return text, spans


def composed(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A name, a number or something like it between any words before and behind it."""
    own = rng.random() < 0.55
    pick = (rng.choice(["N"] * 12 + ["E", "P", "A"]) if own else rng.choice(["{company}", "{company}", "{firm} {firm}", "Project {word}", "{word} Court", "{word} Depot", "{word} & {word} LLP", "the {street} Street site", "{word} Bank", "{word} {street} Lane"]))
    middle = "{" + pick + "}" if own else pick
    second = "{N}" if rng.random() < 0.6 else "{company}"
    before, behind = rng.choice(BEFORE).strip("\n"), rng.choice(BEHIND).strip("\n")
    glue = "" if before[-1:] in '"(' or before.endswith(" ") else " "
    return sentence((before + glue + middle + behind).replace("{N2}", second), rng)


def passage(rng: random.Random, around: list[str], templates: list[str] = TEMPLATES) -> tuple[str, list[tuple[int, int, int]]]:
    """One to three sentences, with running text before and after; spans moved along."""
    text, spans = "", []
    for _ in range(rng.randint(1, 3)):
        if rng.random() < 0.35:
            piece, found = rng.choice(around), []
        else:
            how = rng.random()
            piece, found = composed(rng) if how < 0.4 else sentence(rng.choice(templates if how < 0.77 else DECOYS), rng)
        if text:
            text += rng.choice([" ", " ", " ", "\n", "\n\n", "  "])
        spans += [(a + len(text), b + len(text), k) for a, b, k in found]
        text += piece
    return text, spans
