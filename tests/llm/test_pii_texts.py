"""The personal-data model on texts written by hand, in five languages: recall by kind, and clean texts with numbers."""

from collections import Counter

from cairn.llm import pii_boosting

# kind, text, what is to be found
HOLDING = [
    ("telephone", "You can reach the office on (020) 7946-0958 from nine to five.", "(020) 7946-0958"),
    ("telephone", "Tel. 030/901820 in Berlin, ask for Mr Kern.", "030/901820"),
    ("telephone", "Llame al 912-345-678 por la tarde.", "912-345-678"),
    ("telephone", "My new mobile is 0171 555 0192, the old one is dead.", "0171 555 0192"),
    ("telephone", "Fax: (212) 555-0147", "(212) 555-0147"),
    ("telephone", "Appelez le 01 44 55 66 77 avant midi.", "01 44 55 66 77"),
    ("telephone", "phone 415-555-0133 or come by", "415-555-0133"),
    ("account", "Please pay to IBAN DE89 3704 0044 0532 0130 00 by Friday.", "DE89 3704 0044 0532 0130 00"),
    ("account", "Konto: GB82WEST12345698765432", "GB82WEST12345698765432"),
    ("account", "the account NL91ABNA0417164300 was closed", "NL91ABNA0417164300"),
    ("account", "IBAN FR14 2004 1010 0505 0001 3M02 606 est nouveau", "FR14 2004 1010 0505 0001 3M02 606"),
    ("identity", "Her SSN 123-45-6789 was printed on the card.", "123-45-6789"),
    ("identity", "social security number: 219-09-9999", "219-09-9999"),
    ("birth", "She was born on 03/14/1979 in Leeds.", "03/14/1979"),
    ("birth", "Geboren am 24.12.1981 in Hamburg", "24.12.1981"),
    ("birth", "date of birth: 1990-05-17", "1990-05-17"),
    ("birth", "DOB 7/4/1976, patient of the ward", "7/4/1976"),
    ("mail", "write to anna (at) example (dot) org for the list", "anna (at) example (dot) org"),
    ("mail", "contact: j.smith[at]mail.com", "j.smith[at]mail.com"),
    ("mail", "Mail me: bob at example dot com", "bob at example dot com"),
]
CLEAN = [
    "The order 4711-2233-99 was shipped on 12/05/2021.", "Version 2.10.2019 was published on 03.04.2019.", "ISBN 978-3-16-148410-0 is out of print.", "Chapter 12-34-56 covers lines 1200-1450.",
    "The total was 123.456.78 in the old currency.", "Meeting on 2021-03-04 at the town hall.", "Flight LH 2040 leaves from gate 14 at 16:05.", "Ticket 5551234567 is closed.",
    "Code XK12345678901234567 must be entered twice.", "Look at the dot in the middle of the page.",
]


def test_texts_written_by_hand(spark):
    texts = [t for _, t, _ in HOLDING] + CLEAN
    rows = {r.i: r for r in pii_boosting.with_spans(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    every, found = Counter(k for k, *_ in HOLDING), Counter()
    for i, (kind, text, wanted) in enumerate(HOLDING):
        a = text.index(wanted)
        found[kind] += any(s.start <= a + 2 and s.end >= a + len(wanted) - 2 for s in [*rows[i].base, *rows[i].added])
    marked = [t for i, t in enumerate(CLEAN, len(HOLDING)) if rows[i].base or rows[i].added]
    print({k: (found[k], n) for k, n in every.items()}, marked)
    assert sum(found.values()) >= 0.8 * len(HOLDING) and all(found[k] >= n / 2 for k, n in every.items()) and len(marked) <= 1
