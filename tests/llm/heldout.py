"""Labelled sentences from another source than the generator that problem 10 is fitted on: other frames, names off its list, real formats."""

from __future__ import annotations

import random

GIVEN = """Chidi Folake Thabo Irina Bjorn Sanjay Priyanka Keiko Haruto Linh Oleg Svetlana Zsofia Laszlo Ewa Piotr Agnieszka Mateusz Siobhan Niamh Ciaran
Rhys Anouk Maarten Lotte Sigrid Astrid Torsten Aylin Emre Leila Reza Tariq Zainab Kwame Itzel Joao Thiago Brandon Ashley Tyler Kimberly Gareth Imogen Ulrike Detlef Rocío Íñigo""".split()
FAMILY = """Okonkwo Volkov Mbeki Lindqvist Adeyemi Tanaka Nakamura Kowalski Szabo Horvat Fitzgerald Papadopoulos Yildiz Rahmani Castellanos Ferreira Taylor Johnson Fischer
Brandt Achterberg Ramaswamy Oyelaran Nakagawa Villanueva Etxeberria Dvorak Lehtinen Gudmundsson Mwangi Abdullahi Chatterjee Petrov Ivanova Moreau Lefebvre Bianchi Rossetti""".split()
FRAMES = [
    ("{N} chaired the committee last autumn.", "en"), ("The committee heard {N} before lunch.", "en"), ("Minutes taken by {N}", "en"), ("Kindly forward this note to {N}, who asked for it.", "en"), ("It was {N} who found the leak.", "en"), ("Nobody but {N} had a key.", "en"),
    ("Our neighbour {N} plays the violin.", "en"), ("Present: {N}; {N}", "en"), ("According to {N}, the pipes froze.", "en"), ("Have you seen {N} lately?", "en"), ("Ms {N} will chair the next session.", "en"), ("Ich traf {N} am Bahnhof.", "de"), ("Heute hat {N} Geburtstag.", "de"), ("Herr {N} wartet draußen.", "de"),
    ("La llave la tiene {N} desde ayer.", "es"), ("Ayer vino {N} a cenar.", "es"), ("Don {N} saluda a todos.", "es"), ("Yours faithfully, {N}", "en"), ("A book written by {N} won the prize.", "en"),
    ("Drop me a line: {E}", "en"), ("The list owner is {E}.", "en"), ("You can also try {E} instead.", "en"),
    ("Ring the surgery on {P} before nine.", "en"), ("Switchboard {P}", "en"), ("Meine Nummer lautet {P}.", "de"), ("Mi móvil es el {P}.", "es"),
    ("Her passport, {I}, was stolen.", "en"), ("National identity number {I} does not exist.", "en"), ("Ausweisnummer: {I}", "de"),
    ("The flat at {A} is empty.", "en"), ("Parcels go to {A}.", "en"), ("Er zog nach {A}.", "de"), ("Mi casa está en {A}.", "es"),
]
NOTHING = [
    "Mount Rainier rose behind Crater Lake.", "The Golden Gate Bridge opened in 1937.", "Chapter 12 covers 480 pages.", "South Africa beat New Zealand 24-19.", "Das Rathaus steht am Alten Markt.", "Am Montag tagt der Ausschuss für Verkehr.", "El río Guadalquivir pasa por Sevilla.", "Invoice 4471-2209 was paid on 2023-11-30.",
    "The Royal Opera House seats 2256 people.", "Windows Server 2019 needs 32 GB.", "IBAN GB29 9268 1601 3319 26 belongs to the club.", "We met on Good Friday at 10:45.", "Flight LH 454 left from gate 23.", "The score was 21-19, 18-21, 21-17.", "Lake Victoria is deep.", "Victoria Falls is a town too.", "Serial number 88-19-4431-2 is on the lid.", "Deep Learning and Machine Vision are courses.",
]


def phone(r):
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return r.choice([f"+1 ({r.randint(201, 989)}) {d(3)}-{d(4)}", f"{r.randint(201, 989)}-{d(3)}-{d(4)}", f"+44 20 7{d(3)} {d(4)}", f"+49 {r.randint(151, 179)} {d(7)}", f"+34 6{d(2)} {d(3)} {d(3)}", f"07{d(3)} {d(6)}", f"0{r.randint(30, 89)} {d(7)}"])


def identity(r):
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(8)}{r.choice('TRWAGMYFPDXB')}", f"{r.choice('CFGHJK')}{d(8)}", f"X{d(7)}{r.choice('LMNP')}"])


def address(r):
    street, town = r.choice(["Maple", "Churchill", "Oakfield", "Queensberry", "Harrow"]), r.choice(["Leeds", "Dayton", "Ipswich", "Fresno"])
    return r.choice([f"{r.randint(1, 400)} {street} {r.choice(['Road', 'Street', 'Avenue', 'Lane'])}", f"{r.randint(1, 400)} {street} {r.choice(['Road', 'Drive'])}, {town}", f"Goethestraße {r.randint(1, 99)}, {r.randint(10000, 99999)} Kassel", f"Lindenweg {r.randint(1, 80)}", f"Calle Mayor {r.randint(1, 90)}, {r.randint(10000, 52999)} Toledo"])


def sentences(n: int, seed: int = 17) -> list[tuple[str, list[tuple[int, int, str]]]]:
    r, out = random.Random(seed), []
    for _ in range(n):
        text, spans = "", []
        for k in range(r.randint(1, 2)):
            text += " " if k else ""
            if r.random() < 0.35:
                text += r.choice(NOTHING)
                continue
            frame = r.choice(FRAMES)[0]
            while "{" in frame:
                at = frame.index("{")
                kind = frame[at + 1]
                given, family = r.choice(GIVEN), r.choice(FAMILY) + ("-" + r.choice(FAMILY) if r.random() < 0.1 else "")
                item = {"N": lambda g=given, f=family: r.choices([f"{g} {f}", f"{f}, {g}", f"{g} {r.choice('BDKRST')}. {f}", f"{g[0]}. {f}"], [6, 1, 1, 1])[0], "E": lambda g=given, f=family: r.choice([f"{g}.{f}@posteo.net", f"{f}{r.randint(1, 99)}@uni-mail.edu", f"{g}_{f} (at) kontor (dot) org"]).lower(), "P": lambda: phone(r), "I": lambda: identity(r), "A": lambda: address(r)}[kind]()
                text += frame[:at]
                spans.append((len(text), len(text) + len(item), {"N": "person_name", "E": "email", "P": "phone", "I": "id_number", "A": "address"}[kind]))
                text, frame = text + item, frame[at + 3 :]
            text += frame
        out.append((text, spans))
    return out
