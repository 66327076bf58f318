"""Labelled spans built from general vocabulary, and the training of the tagger on them.

``python -m tracefold.llm.pii_train SECONDS`` writes the weights. Every example
is generated from public, general word lists (common given names and surnames,
large cities, basic English words, notations of numbers in several countries)
and from made-up syllables; sentences around a span are put together word by
word, not taken from any text. Nothing is read from the tables.
"""

from __future__ import annotations

import random
import sys
from multiprocessing import Pool

import numpy as np

from tracefold.llm.pii_model import KINDS, WEIGHTS, codes, emissions, load, loss_and_gradients, new_weights, viterbi

FIRST = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Karen Christopher Sarah Charles Lisa Daniel Nancy Matthew Sandra "
    "Anthony Betty Mark Ashley Donald Emily Steven Kimberly Andrew Margaret Paul Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah Timothy Stephanie Ronald Rebecca "
    "Jason Sharon Edward Laura Jeffrey Cynthia Ryan Dorothy Jacob Amy Gary Kathleen Nicholas Angela Eric Shirley Jonathan Emma Stephen Brenda Larry Pamela Justin Nicole Scott Anna Brandon "
    "Samantha Benjamin Katherine Samuel Christine Gregory Helen Alexander Debra Patrick Rachel Frank Carolyn Raymond Janet Jack Maria Peter Hannah Klaus Sabine Jürgen Ursula Wolfgang Petra "
    "Björn Ingrid Lars Astrid Pierre Camille François Amélie Jean Chloé Carlos Lucía José Carmen Miguel Paula Giovanni Francesca Marco Giulia João Beatriz Piotr Agnieszka Ivan Olga Dmitri "
    "Natalia Ahmed Fatima Mohammed Aisha Yusuf Leila Raj Priya Arjun Ananya Wei Li Hiroshi Yuki Kenji Sakura Min Ji Thabo Nomsa Kofi Ama Harry Barack Oliver Sophie Liam Mia Noah Lena"
).split()
LAST = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Perez Thompson White Harris "
    "Sanchez Clark Ramirez Lewis Robinson Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts Müller Schmidt "
    "Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Krüger Dubois Durand Lefebvre Moreau Laurent Simon Michel "
    "Rossi Russo Ferrari Esposito Bianchi Romano Silva Santos Oliveira Sousa Kowalski Nowak Wójcik Ivanov Petrov Smirnov Hansen Johansen Andersson Johansson Nielsen Jensen Larsen Virtanen "
    "Korhonen de_Vries van_Dijk Bakker Jansen Khan Ali Hussain Patel Singh Kumar Sharma Gupta Wang Zhang Chen Liu Yang Tanaka Suzuki Sato Takahashi Kim Park Choi Okafor Mensah Dlamini "
    "O'Brien O'Connor McDonald MacLeod Murphy Kelly Ryan Evans Hughes Potter Obama Mozart Borg Stewart Turner Phillips Parker Collins Edwards Morris Rogers Reed Cook Morgan Bell Cooper"
).split()
CITIES = (
    "London Paris Madrid Rome Vienna Prague Warsaw Budapest Lisbon Dublin Oslo Stockholm Copenhagen Helsinki Brussels Amsterdam Zürich Geneva Munich Hamburg Cologne Frankfurt Stuttgart Dresden "
    "Milan Naples Turin Barcelona Seville Valencia Marseille Toulouse Bordeaux Nantes Manchester Bristol Glasgow Edinburgh Cardiff Chicago Boston Denver Seattle Houston Phoenix Dallas Atlanta "
    "New_York Los_Angeles San_Diego Las_Vegas New_Orleans Salt_Lake_City Toronto Vancouver Montréal Sydney Melbourne Auckland Tokyo Osaka Mumbai Delhi Nairobi Cape_Town Rio_de_Janeiro Mexico_City"
).split()
BASIC = (
    "the a an and or but if of to in on at by with from for as this that these it we you they he she is are was were be been has have had do does did not no all any some each every other another "
    "new old good great small large long short high low early late first last next same open free full left right number part place point group area case week month year day time way work "
    "world house water paper music book letter story game team school office market river garden field mountain forest bridge tower castle station museum library kitchen window door table "
    "chair lamp clock picture colour sound voice light fire ground stone metal glass wood cotton silver gold iron blue red black white brown yellow grey north south east west spring summer "
    "winter autumn morning evening night add ask bring build buy carry change check choose close come copy cut draw drive end fall find follow get give go help hold keep know lead learn "
    "leave let look make meet move need pay plan play put read run say see sell send set show start stop take talk tell test think turn use wait walk want"
).split()
TECH = (
    "server client cache index file folder image page link button form menu layer model module package plugin theme script style query filter field column record key value token header body status "
    "error warning event log trace session network router packet driver kernel thread buffer stream socket engine parser compiler browser desktop mobile app update release version branch commit"
).split()
STREET = "Street St. Avenue Ave Road Rd Lane Ln Drive Dr Way Court Ct Terrace Close Crescent Boulevard Blvd Square Place Hill Row Parkway Gardens Walk Grove".split()
GERMAN = "straße strasse str. weg platz allee gasse ring ufer damm".split()
ROMANCE = ["rue", "rue de", "rue de la", "rue du", "rue des", "avenue", "avenue de", "boulevard", "place de la", "impasse", "chemin du"]
SPANISH = ["Calle", "Calle de", "Calle del", "Avenida", "Avenida de", "Plaza", "Paseo de", "Via", "Viale", "Piazza", "Corso", "Rua", "Rua do", "Largo"]
DOMAINS = "gmail yahoo outlook hotmail icloud proton fastmail mail".split()
TLDS = "com org net edu de fr es it nl co.uk com.au io eu info example test invalid".split()
CONSONANTS = "b c d f g h j k l m n p qu r s t v w x z br cr dr fr gr kl kr pl pr st sk str tr th ch sh ph zw".split()
VOWELS = "a e i o u ai au ea ei ie oa ou y".split()
ENDS = ["", "", "", "r", "n", "s", "l", "t", "x", "m", "nd", "rd", "ck", "ng"]
SUFFIXES = "son sen mann berg stein ski sky ova ini etti ez es ton ley ford well dal lund ström kov enko ian oğlu wala".split()
CSS = "media import page charset supports layer keyframes font-face namespace".split()


def made_up(r: random.Random, lo: int = 1, hi: int = 3) -> str:
    return "".join(r.choice(CONSONANTS) + r.choice(VOWELS) for _ in range(r.randint(lo, hi))) + r.choice(ENDS)


def digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def hexes(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789abcdef") for _ in range(n))


def word(r: random.Random) -> str:
    x = r.random()
    if x < 0.05:
        return f"{r.choice([*BASIC, *TECH])}-{r.choice([*BASIC, *TECH])}"
    return r.choice(BASIC) if x < 0.6 else r.choice(TECH) if x < 0.8 else made_up(r) if x < 0.97 else made_up(r) + r.choice(["ed", "ing", "er", "s", "ly", "est"])


def words(r: random.Random, lo: int, hi: int) -> str:
    return " ".join(word(r) for _ in range(r.randint(lo, hi)))


def first_name(r: random.Random) -> str:
    return r.choice(FIRST) if r.random() < 0.7 else made_up(r, 1, 2).capitalize()


def surname(r: random.Random) -> str:
    x = r.random()
    if x < 0.4:
        return r.choice(LAST).replace("_", " ")
    if x < 0.9:
        return (made_up(r, 1, 2) + r.choice(["", *SUFFIXES])).capitalize()
    return f"{(made_up(r, 1, 2)).capitalize()}-{r.choice(LAST).replace('_', ' ')}"


def city(r: random.Random) -> str:
    return r.choice(CITIES).replace("_", " ") if r.random() < 0.5 else r.choice(["", "", "Bad ", "Saint-", "San ", "Port ", "New "]) + (made_up(r, 1, 2) + r.choice(["", "burg", "ton", "ville", "stadt", "ham", "ford", "dorf", "by"])).capitalize()


def name(r: random.Random, told: bool = True) -> str:
    """A person's name. Where nothing before it tells (``told``), the given name is a common one and no letters are small."""
    f, s, m = first_name(r) if told else r.choice(FIRST), surname(r), r.choice("ABCDEFGHIJKLMNOPRSTUVW")
    if r.random() < 0.08:
        f = f"{f} {first_name(r)}"
    if told and r.random() < 0.08:
        f, s = r.choice(FIRST).lower(), surname(r).lower()
        return r.choice([f"{f} {s}", f"{f} {s}", f"{s}, {f}"])
    title = r.choice(["Mr", "Mr.", "Mrs.", "Ms.", "Miss", "Dr.", "Dr", "Prof.", "Herr", "Frau", "Sir"])
    return r.choices(
        [f"{f} {s}", f"{f} {m}. {s}", f"{s}, {f}", f"{s.upper()}, {f}", f"{title} {s}", f"{title} {f} {s}", f"{f.upper()} {s.upper()}", f"{m}. {s}", f"{title} {m}. {s}"], [10, 3, 2, 2, 2, 1, 1, 0.5, 1]
    )[0]


def email(r: random.Random) -> str:
    f, s = first_name(r).lower().split(" ")[0], surname(r).lower().split(" ")[0].replace("'", "")
    local = r.choice([f"{f}.{s}", f"{f}{s}", f"{f}_{s}", f"{f}-{s}", f"{f[0]}{s}", f"{f}{r.randint(1, 2010)}", f"{s}.{f}", f"{s}{f[0]}", made_up(r), f"{made_up(r, 1, 1)}{digits(r, 3)}", r.choice(["info", "office", "support", "contact", "sales"]), f"{f}+{made_up(r, 1, 1)}", f"{s}_{f}+{r.choice(BASIC)}"])
    host = r.choice(DOMAINS) if r.random() < 0.35 else made_up(r, 1, 3)
    if r.random() < 0.2:
        host = f"{r.choice([made_up(r, 1, 1), 'mail', 'post', 'work'])}.{host}"
    out = f"{local}@{host}.{r.choice(TLDS)}"
    x = r.random()
    if x < 0.06:
        return out.upper()
    if x < 0.22:
        a, d = r.choice([(" (at) ", "."), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" at ", " dot "), (" AT ", " DOT "), (" (at) ", " (dot) "), ("{at}", "{dot}"), (" [at] ", ".")])
        user, host = out.split("@")
        return (user.replace(".", d) if r.random() < 0.5 else user) + a + host.replace(".", d)
    return out


def _grouped(r: random.Random, n: int, sep: str) -> str:
    out, left = [], n
    while left:
        k = min(left, r.choice([2, 2, 3, 3, 4]))
        k = left if left - k == 1 else k
        out.append(digits(r, k))
        left -= k
    return sep.join(out)


def phone(r: random.Random, bare: bool = False) -> str:
    sep = r.choice([" ", " ", "-", ""])
    a, b, c = str(r.randint(2, 9)) + digits(r, 2), digits(r, 3), digits(r, 4)
    if r.random() < 0.15:
        b = "555"
    cc = r.choice(["1", "7", "20", "27", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91", "351", "353", "358", "420", "971"])
    if bare:
        return r.choice([f"{a}{b}{c}", f"{a}{b}{c}", "0" + digits(r, r.randint(8, 10)), cc + digits(r, r.randint(8, 10)), digits(r, r.randint(7, 8))])
    return r.choice([
        f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+{cc}{r.choice([' ', '', '-', ' '])}{_grouped(r, r.randint(8, 10), sep)}", f"+{cc} {r.randint(1, 9)}{digits(r, r.randint(0, 2))} {digits(r, r.randint(5, 8))}",
        f"+{cc} ({r.randint(1, 9)}{digits(r, 2)}) {_grouped(r, 7, r.choice(' -'))}", f"00{cc}{sep}{_grouped(r, r.randint(8, 10), sep)}", f"0{digits(r, r.randint(1, 4))}{r.choice([' ', '/', '-', ' / '])}{_grouped(r, r.randint(5, 8), r.choice(['', ' ', '-']))}", f"(0{digits(r, r.randint(2, 4))}) {_grouped(r, r.randint(5, 7), r.choice(['', ' ']))}",
        f"+{cc} {digits(r, r.randint(1, 4))} {digits(r, r.randint(3, 4))} {digits(r, r.randint(3, 4))}", f"00{cc} {digits(r, r.randint(1, 4))} {digits(r, r.randint(5, 8))}", f"+{cc} {digits(r, 1)} {digits(r, 2)} {digits(r, 2)} {digits(r, 2)} {digits(r, 2)}", f"+{cc} {digits(r, r.randint(2, 3))} {digits(r, r.randint(4, 6))} {digits(r, r.randint(2, 4))}",
        f"0{r.randint(1, 9)} {digits(r, 2)} {digits(r, 2)} {digits(r, 2)} {digits(r, 2)}", f"+{cc}{digits(r, r.randint(8, 11))}", f"{a}-{b}-{c} ext. {digits(r, 3)}", f"+{cc} {digits(r, 2)} {digits(r, 4)} {digits(r, 4)}", f"+{cc} {digits(r, 4)} {digits(r, 6)}", f"+{cc} {digits(r, 2)} {digits(r, 5)} {digits(r, 3)}",
    ])


def card(r: random.Random) -> str:
    """A run of card length; whether its check digit holds is decided after the tagger, not by it."""
    x = r.random()
    if x < 0.15:
        d, cut = "3" + r.choice("47") + digits(r, 13), (4, 6, 5)
    else:
        d, cut = r.choice("234569") + digits(r, 15), (4, 4, 4, 4)
    sep, out, at = r.choice(["", "", " ", "-"]), [], 0
    for k in cut:
        out.append(d[at : at + k])
        at += k
    return sep.join(out)


def id_number(r: random.Random, bare: bool = False) -> str:
    up = "ABCDEFGHJKLMNPRSTVWXYZ"
    if bare:
        return r.choice([digits(r, 9), digits(r, 9), digits(r, 11), digits(r, 8)])
    return r.choice([
        *[f"{digits(r, 3)}-{digits(r, 2)}-{digits(r, 4)}"] * 5, f"{digits(r, 3)} {digits(r, 2)} {digits(r, 4)}", f"{r.choice(up)}{r.choice(up)} {digits(r, 2)} {digits(r, 2)} {digits(r, 2)} {r.choice('ABCD')}", f"{r.choice(up)}{r.choice(up)} {digits(r, 2)} {digits(r, 2)} {digits(r, 2)} {r.choice('ABCD')}",
        f"{r.choice(up)}{r.choice(up)}{digits(r, 6)}{r.choice('ABCD')}", f"{r.choice(up)}{digits(r, r.randint(7, 8))}", f"{r.choice(up)}{r.choice(up)}{digits(r, 7)}", f"{digits(r, 8)}{r.choice(up)}", f"{r.choice('12')} {digits(r, 2)} {digits(r, 2)} {digits(r, 2)} {digits(r, 3)} {digits(r, 3)} {digits(r, 2)}",
        f"{digits(r, 6)}-{digits(r, 4)}", f"{digits(r, 2)} {digits(r, 6)} {r.choice(up)} {digits(r, 3)}", f"{digits(r, 3)}.{digits(r, 3)}.{digits(r, 3)}-{digits(r, 2)}", card(r), card(r), card(r), card(r),
    ])


def address(r: random.Random) -> str:
    n = str(r.randint(1, 480)) + r.choice(["", "", "", "", "a", "B"])
    base = r.choice([made_up(r, 1, 3).capitalize(), made_up(r, 2, 3).capitalize(), r.choice(BASIC[70:]).capitalize(), r.choice(LAST).replace("_", " "), f"{r.choice(['Old', 'New', 'Upper', 'Lower', 'North', 'West', 'Great'])} {r.choice([made_up(r).capitalize(), r.choice(BASIC[70:]).capitalize()])}"])
    tail = r.choice(["", "", f", {city(r)}", f", {city(r)}", f", {city(r)} {digits(r, 5)}", f", {city(r)}, {r.choice(['CA', 'NY', 'TX', 'WA', 'OH', 'IL'])} {digits(r, 5)}", f", {digits(r, 4)} {city(r)}", f"\n{city(r)}", f", {r.choice('BEGLMNSW')}{digits(r, 1)} {digits(r, 1)}{r.choice('ABDEFGH')}{r.choice('JLNPQRST')}"])
    x = r.random()
    if x < 0.5:
        unit = r.choice(["", "", "", "", f", Apt {digits(r, 2)}", f", Flat {r.randint(1, 9)}", f", Suite {digits(r, 3)}", f" #{digits(r, 2)}"])
        return f"{n} {base} {r.choice(STREET)}{unit}{tail}"
    if x < 0.72:
        return r.choice([f"{base}{r.choice(GERMAN)} {n}{r.choice(['', f', {digits(r, 5)} {city(r)}'])}", f"{base}{r.choice(['-Straße', ' Straße', 'er Straße', '-Allee'])} {n}, {digits(r, 5)} {city(r)}", f"{r.choice(['Am', 'Im', 'An der', 'Auf dem', 'Zum'])} {base} {n}{r.choice(['', f', {digits(r, 5)} {city(r)}'])}"])
    if x < 0.87:
        return f"{n}{r.choice(['', ','])} {r.choice(ROMANCE)} {base}{r.choice(['', '', f', {digits(r, 5)} {city(r)}', f', {city(r)}'])}"
    return f"{r.choice(SPANISH)} {base}{r.choice([' ', ', ', ' nº '])}{r.randint(1, 200)}{r.choice(['', '', f', {city(r)}', f', {digits(r, 5)} {city(r)}', f', {r.randint(1, 9)}º', f', piso {r.randint(1, 9)}'])}"


MAKE = {"email": email, "phone": phone, "id_number": id_number, "address": address, "name": name}
KEYS = {
    "email": "email mail e-mail user_email userEmail mailto from to cc bcc sender recipient login username account contact".split(),
    "phone": "phone tel telephone mobile cell fax phone_number phoneNumber msisdn call whatsapp sms contact".split(),
    "id_number": "ssn id_number passport passport_no national_id nationalId tax_id nino insurance_no card card_number cardNumber pan cc_number account_holder_id document dni".split(),
    "address": "address addr street street_address shipping billing shippingAddress home ship_to line1 destination delivery location".split(),
    "name": "name full_name fullName customer client contact user author owner recipient holder cardholder passenger guest patient employee to attn".split(),
}
#: Words that may stand right before a value in a sentence; the rest of the sentence is random.
LEADS = {
    "email": "mail email write message contact reach forward reply send copy".split(),
    "phone": "phone call ring dial text telephone tel. fax mobile number cell".split(),
    "id_number": "SSN passport licence insurance ID identity card number document social security".split(),
    "address": "at address lives street home office located ship deliver moved visit near".split(),
    "name": "by with from for to contact Dear Hello Hi regards sincerely signed author manager customer patient employee met says said wrote asked thanks".split(),
}


def decoy(r: random.Random) -> str:
    """Something that looks like one of the kinds and is none."""
    w, cap = (lambda: word(r)), (lambda: word(r).capitalize())
    n = lambda k: digits(r, k)
    x = r.randint(0, 39)
    if x < 6:  # capitalised words in a row: titles, products, places, brands
        return r.choice([f"{cap()} {cap()}", f"{cap()} {cap()} {cap()}", f"{cap()} {cap()} and {cap()} {cap()}", f"{made_up(r).capitalize()} {cap()}", f"{cap()} {made_up(r).capitalize()} {cap()}", r.choice(CITIES).replace("_", " "), f"{r.choice(CITIES).replace('_', ' ')} {cap()}", f"{r.choice(['The', 'A', 'This', 'Your', 'Our', 'No', 'All'])} {cap()} {cap()}"])
    if x < 8:  # small letters, quoted or not, and capitals
        return r.choice([f'"{w()} {w()}"', f'\\"{w()} {w()}\\"', f"'{w()} {w()}'", f"{w()} {w()}", w().upper(), f"{w()} {w().upper()} {w()}", f"{cap()} {n(r.randint(1, 4))}", f"{cap()} {n(3)} {w()}"])
    if x < 12:  # a given name alone, or as part of the name of a thing
        f, t = r.choice(FIRST), r.choice(TECH)
        return r.choice([f"{f} {t}", f"{f} {t.capitalize()}", f"the {f} {t}", f"{t.capitalize()} {f}", f"{f} {n(1)}.{n(1)}", f"{f} {r.choice(BASIC[70:])}", f, f"{f} {cap()} {t}"])
    if x < 15:
        return r.choice([f"{r.choice(['Monday', 'Tuesday', 'Friday', 'Sunday'])} {cap()}", f"{r.choice(['January', 'March', 'May', 'June', 'August'])} {r.randint(1, 31)}", f"{r.choice(['Mon', 'Wed', 'Sat'])}, {n(2)} {r.choice(['Jan', 'Apr', 'Oct'])} 20{n(2)}", f"20{n(2)}-{n(2)}-{n(2)}", f"{n(2)}/{n(2)}/20{n(2)}", f"{n(2)}:{n(2)}:{n(2)}", f"20{n(2)}-{n(2)}-{n(2)}T{n(2)}:{n(2)}:{n(2)}.{n(3)}Z", f"{n(2)}.{n(2)}.20{n(2)}"])
    if x < 22:  # long numbers without a meaning
        return r.choice([f"1{r.choice('5678')}{n(8)}", f"1{r.choice('5678')}{n(11)}", f"1{r.choice('5678')}{n(14)}", f"{w()} {n(10)}", n(12), n(14), n(18), n(20), f"{n(2)}-{n(4)}-{n(2)}", f"{n(4)}-{n(2)}", f"{n(3)}.{n(3)}", f"{n(2)}-{n(2)}-{n(4)}", f"{n(3)}-{n(3)}", f"{n(4)} {n(3)} {n(2)}", f"{n(4)}-{n(4)}", f"{n(3)},{n(3)},{n(3)}", f"{n(1)}{n(6)}", f"#{n(6)}", f"-{n(1)}.{n(9)}", f"0.{n(8)}", f"{n(3)}-{n(3)}-{n(3)}-{n(3)}", f"{n(2)} {n(2)} {n(2)}", f"{n(4)}.{n(4)}", f"{w()} {n(4)}.{n(4)}", f"{n(5)}.{n(3)}", f"{n(r.randint(1, 6))}.{n(r.randint(1, 6))}", f"{n(4)}/{n(4)}", f"{n(3)}:{n(5)}", f"{n(4)} {n(4)}"])
    if x < 26:
        return r.choice([f"{r.randint(0, 30)}.{n(1)}.{n(2)}", f"v{n(1)}.{n(2)}", f"{n(1)}.{n(1)}.{n(3)}.{n(1)}", f"{r.randint(1, 255)}.{n(2)}.{n(3)}.{n(2)}", f"{n(2)}.{n(3)}.{n(4)}.{n(1)}", f"{n(1)}.{n(1)}.{n(4)}.{n(3)}", f"{made_up(r)}-{made_up(r)}@{n(1)}.{n(2)}.{n(1)}", f"{w()}@{n(1)}x.png", f"@{r.choice(CSS)}", f"@{made_up(r)}/{made_up(r)}", f"@{w()}", f"{w()}@{n(2)}"])
    if x < 30:
        return r.choice([hexes(r, r.choice([8, 10, 16, 32, 40])), f"{hexes(r, 8)}-{hexes(r, 4)}-{hexes(r, 4)}-{hexes(r, 4)}-{hexes(r, 12)}", f"#{hexes(r, 6)}", f"{r.choice('ABCDEFGH')}{r.choice('ABCDEFGH')}-{n(4)}", f"{made_up(r, 1, 1)}{n(4)}{made_up(r, 1, 1)}", f"{n(4)}{r.choice('abcdef')}{n(4)}", f"{r.choice('abcdef')}{n(7)}", f"0x{hexes(r, 8)}"])
    if x < 36:  # a word of streets, or a house number, without an address
        s = r.choice([*STREET, "Room", "Floor", "Unit", "Chapter", "Section", "Level", "Step", "Table", "Figure", "Line", "Rack", "Bay", "Gate", "Zone", "Page", "Part"])
        return r.choice([f"{s} {r.randint(1, 99)}", f"{s}-{r.randint(1, 99)}", f"{cap()} {s}", f"{r.randint(1, 99)} {w()}", f"{r.randint(2, 9)} {cap()} {w()}", f"{s} {cap()}", f"the {s.lower()} {w()}", f"{cap()} {r.randint(1, 99)}", f"{r.randint(1, 99)} {cap()}", f"{cap()} {s} {r.randint(1, 9)}.{n(1)}", f"{n(4)} {w()} {w()}", f"the {r.randint(2, 5)} {s} {w()}", f"{cap()} {r.randint(1, 9)} {cap()}"])
    return r.choice([f"{n(2)}%", f"{n(3)} MB", f"{n(2)}:{n(1)}", f"{n(2)}x{n(2)}", f"${n(2)}.{n(2)}", f"{n(3)} ms", f"{n(4)}x{n(3)}px", f"HTTP/{n(1)}.{n(1)} {n(3)}", f":{n(4)}", f"{n(1)}-{n(1)}-{n(1)}", f"({n(2)}, {n(2)})", f"[{n(2)}]", f"{n(3)} at {n(2)}", f"look at {made_up(r)} dot {w()}"])


Span = tuple[str, str | None]


def sentence(r: random.Random, kind: str | None) -> list[Span]:
    """Random words with one value, or a decoy, or nothing, among them."""
    before, after = words(r, 0, 6), words(r, 0, 6)
    if kind is None:
        mid: list[Span] = [(decoy(r), None)] if r.random() < 0.75 else []
        if mid and r.random() < 0.1:  # words that go before values go before others too
            before = (before + " " + r.choice(LEADS[r.choice(KINDS)])).strip()
    else:
        lead = r.random() < 0.6
        if kind == "name":
            value = name(r, told=lead)
        else:
            value = MAKE[kind](r, bare=True) if kind in ("phone", "id_number") and lead and r.random() < 0.3 else MAKE[kind](r)
        if lead:
            x = r.choice(LEADS[kind])
            before = " ".join(x for x in (before, x, r.choice(["", "", "", "is", "no.", "number", "of", "on", "at"]) if kind != "name" else "") if x)
        mid = [(value, kind)]
    if before:
        before = (before[0].upper() + before[1:] if r.random() < 0.7 else before) + r.choice([" ", " ", " ", " ", ": ", ", ", " (", ' "', "\n", " <"])
    after = (r.choice([" ", " ", ", ", "; ", ") ", '" ', ". ", ">, "]) if after and mid else "") + after + r.choice([".", ".", ".", "!", "?", "", ";", ":"])
    return [(before, None), *mid, (after, None)]


def member(r: random.Random, kind: str | None, style: int) -> list[Span]:
    """A key with its value, as in JSON (0), a form (1), a log line (2) or markup (3)."""
    if kind is None:
        key = r.choice([word(r), made_up(r), "id", "ts", "time", "ref", "q", "page", "sort", "v", "cid", "sid", "utm", r.choice(KEYS[r.choice(KINDS)])])
        value: list[Span] = [(r.choice([decoy(r), decoy(r), word(r), words(r, 2, 3), sentence(r, None)[0][0].strip(), digits(r, r.randint(1, 6)), made_up(r), "true", "null", ""]), None)]
    else:
        key = r.choice(KEYS[kind])
        if kind == "name" and r.random() < 0.12:
            q = ('"', '"') if style == 0 else ("", "")
            one, two = r.choice([("first_name", "last_name"), ("firstName", "lastName"), ("given_name", "family_name"), ("fname", "lname")])
            sep = {0: ('"%s":' + r.choice(["", " "]), ","), 1: ("%s=", "&"), 2: ("%s=", " "), 3: ("<%s>", "</x>")}[style]
            f, s = first_name(r), surname(r)
            return [(sep[0] % one + q[0], None), (f, "name"), (q[1] + sep[1] + sep[0] % two + q[0], None), (s, "name"), (q[1], None)]
        if r.random() < 0.3:
            key = r.choice([made_up(r, 1, 2), word(r), "q", "u", "p", "text", "value", "data"])
            value = [(MAKE[kind](r), kind)]
        else:
            value = [(MAKE[kind](r, bare=True) if kind in ("phone", "id_number") and r.random() < 0.3 else MAKE[kind](r), kind)]
    key = key if r.random() < 0.9 else key.upper()
    if style == 0:
        return [(f'"{key}":{r.choice(["", " "])}"', None), *value, ('"', None)]
    if style == 3:
        tag = r.choice(["td", "p", "span", "li", "b", "div", key])
        return [(f"<{tag}>", None), *value, (f"</{tag}>", None)]
    return [(key + r.choice(["=", "=", ": "] if style == 2 else ["="]), None), *value]


def example(r: random.Random, width: int) -> tuple[str, np.ndarray]:
    """A window of a made-up text; where it begins is random, so values stand anywhere and are cut at edges too."""
    parts: list[Span] = []
    pick = lambda share: r.choice((*KINDS, "name")) if r.random() < share else None
    form = r.random()
    if form < 0.45:
        join = r.choice([" ", " ", "\n", "\n\n", "</p>\n<p>", "<br>", "\\n"])
        for _ in range(r.randint(2, 5)):
            parts += [*sentence(r, pick(0.4)), (join, None)]
    else:
        style = r.choice([0, 0, 1, 1, 1, 2, 3])
        join = {0: r.choice([",", ", ", ",\n  ", "},{"]), 1: "&", 2: r.choice([" ", ", ", "; ", "\n"]), 3: r.choice(["", "\n"])}[style]
        parts = [(r.choice(["", "", f"https://{made_up(r)}.{r.choice(TLDS)}/{made_up(r)}/{word(r)}?", f"/{word(r)}?", "{"]), None)]
        if style == 1 and r.random() < 0.3:
            kind = pick(0.5)
            parts = [(f"https://{made_up(r)}.{r.choice(TLDS)}/{r.choice([word(r), made_up(r)])}/", None), (MAKE[kind](r) if kind else made_up(r), kind), (r.choice(["?", "/", "#", ""]), None)]
        for _ in range(r.randint(2, 7)):
            kind = pick(0.4)
            if style == 0 and r.random() < 0.25:
                parts += [(f'"{r.choice(["text", "message", "note", "body", word(r)])}":"', None), *sentence(r, kind), ('"', None), (join, None)]
            else:
                parts += [*member(r, kind, style), (join, None)]
    text, tags = "", []
    for s, kind in parts:
        if kind == "name" and s.isspace():
            kind = None
        text += s
        t = 0 if kind is None else 2 + 2 * KINDS.index(kind)
        tags += [t] * len(s)
        if kind is not None and s:
            tags[-len(s)] = t - 1
    off = r.randint(0, max(0, len(text) - width)) if r.random() < 0.7 else 0
    cut = tags[off : off + width]
    return text[off : off + width], np.array(cut + [0] * (width - len(cut)))


def batch(seed: int, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    r = random.Random(seed)
    ids = np.zeros((n, width), dtype=np.int64)
    tags = np.zeros((n, width), dtype=np.int64)
    for i in range(n):
        s, t = example(r, width)
        ids[i, : len(s)] = codes(s)
        tags[i] = t
    return ids, tags


def _work(job: tuple[dict, int, int, int]) -> tuple[float, dict]:
    w, seed, n, width = job
    return loss_and_gradients(w, *batch(seed, n, width))


def held_out(w: dict, seed: int = 10**9, n: int = 2000, width: int = 128) -> dict[str, float]:
    """Share of characters tagged right, and of characters of each kind, on examples never trained on."""
    ids, tags = batch(seed, n, width)
    got = viterbi(w, np.ascontiguousarray(emissions(w, ids).transpose(1, 2, 0)), (ids > 0).sum(1))
    kind, true = (got + 1) // 2, (tags + 1) // 2
    out = {"all": float((kind == true)[ids > 0].mean()), "outside": float((kind == 0)[(true == 0) & (ids > 0)].mean())}
    return out | {k: float((kind == i + 1)[true == i + 1].mean()) for i, k in enumerate(KINDS)}


def train(steps: int, seconds: float, workers: int = 6, n: int = 96, width: int = 128, rate: float = 3e-3, path: str = WEIGHTS, resume: bool = False) -> None:
    """Adam over the mean gradients of the workers, the rate falling to nothing by the end of ``steps`` or ``seconds``."""
    import time

    w = load(path) if resume else new_weights()
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    began, seed0 = time.time(), 1 + (110_000_000 if resume else 0)
    with Pool(workers) as pool:
        for step in range(1, steps + 1):
            done = min(1.0, max(step / steps, (time.time() - began) / seconds))
            got = pool.map(_work, [(w, seed0 + step * workers + k, n, width) for k in range(workers)])
            g = {k: sum(x[1][k] for x in got) / workers for k in w}
            norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
            scale = min(1.0, 5.0 / (norm + 1e-9))
            lr = (1e-3 if resume else rate) * (1 - done) + 1e-4
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k] * scale
                v[k] = 0.99 * v[k] + 0.01 * (g[k] * scale) ** 2
                w[k] = (w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            if step % 50 == 0:
                print(step, round(sum(x[0] for x in got) / workers, 3), round(time.time() - began), flush=True)
            if step % 500 == 0:
                np.savez_compressed(path, **{k: x.astype(np.float16) for k, x in w.items()})
            if done >= 1:
                break
    np.savez_compressed(path, **{k: x.astype(np.float16) for k, x in w.items()})
    print({k: round(x, 4) for k, x in held_out(load(path)).items()})


if __name__ == "__main__":
    train(100_000, float(sys.argv[1]) if len(sys.argv) > 1 else 1200.0, resume="--resume" in sys.argv)
