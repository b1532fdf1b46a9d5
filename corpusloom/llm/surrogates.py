"""Personal data replaced by keyed, type-consistent surrogates.

Every detected entity is reduced to a canonical form and mapped by a keyed
permutation of its own type and format: digits stay digits, letters keep case
and script, separators stay, a valid card number gets a valid one, a listed
first name gets one of the same gender and script, any other name keeps its
pattern of sounds and the ending that tells its gender.  A permutation cannot
merge two entities, and one entity has the same surrogate everywhere.

A collision check runs over the distinct entities of the corpus: a surrogate
that is itself the value of an entity there is drawn again, with the next tweak,
until it is neither an entity nor any entity's surrogate, at most ``DRAWS``
times.  What then has none (formats with few values, all in use), and values
without a character that could change, get a typed placeholder numbered by the
key: ``[phone-...]``, for names a long invented name.  So the check always ends.
Listed names trade places within their lists; they stay distinct, and are
always somebody's name.

Names are found after titles and ranks, by listed first names and surnames, by
endings that only surnames have, and by what stands around them ("my name is",
"said"), unless one of the words names an institution, a place or a day, an
article stands before, or what follows speaks of a thing; in Chinese, Japanese,
Korean, Arabic and Hindi behind introductions.  A name found anywhere in a
document is replaced there at every bare mention.

Defined cases: a null text stays null and has no entities; empty texts and texts
without entities come back unchanged; a null ``doc_id`` is passed through;
repeated rows are treated alike; an empty table gives an empty result; other
columns are left as they are; texts are searched whole, however long, in linear
time.
"""

from __future__ import annotations

import functools
import hashlib
import re
import secrets
import unicodedata
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import cut, fresh

#: Changed draws, in rows and in characters, up to which they are broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_CHARS = 16_000_000
#: Draws after the first one before a placeholder is taken.
DRAWS = 6
ROUNDS = 12
#: Letters above which a value is permuted by halves, in linear time.
LONG = 1024
LONG_ROUNDS = 6

# ---------------------------------------------------------------- detection

FIRST = {
    ("latin", "m"): "James John Robert Michael David William Richard Thomas Daniel Peter Hans Klaus Karl Jean Pierre Luis Carlos Juan Miguel Antonio".split(),
    ("latin", "f"): "Mary Anna Susan Linda Sarah Karen Laura Julia Emma Alice Ursula Heike Marie Claire Sophie Maria Carmen Lucia Isabel Elena".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана".split(),
}
#: More first names; each list trades places within itself.
MORE = {
    ("latin", "m"): (
        "James John Robert Michael David William Richard Thomas Daniel Peter Hans Klaus Karl Jean Pierre Luis Carlos Juan Miguel Antonio "
        "Joseph Charles Christopher Matthew Anthony Donald Steven Stephen Andrew Paul Joshua Kenneth Kevin Brian George Timothy Ronald Edward "
        "Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Raymond Jerry "
        "Dennis Tyler Aaron Jose José Adam Nathan Henry Zachary Douglas Kyle Noah Ethan Jeremy Walter Keith Roger Terry Harry Lawrence Sean "
        "Christian Albert Austin Arthur Jesse Dylan Bryan Joe Jordan Billy Bruce Gabriel Logan Alan Roy Ralph Randy Eugene Vincent Russell Louis "
        "Philip Bobby Johnny Bradley Simon Martin Oliver Liam Lucas Leon Felix Jonas Max Moritz Stefan Andreas Jürgen Wolfgang Uwe Bernd Dieter "
        "Günter Günther Heinz Helmut Horst Gerhard Manfred Werner Rainer Ralf Matthias Markus Sebastian Tobias Florian Jan Jens Sven Torsten "
        "Thorsten Dirk Holger Volker Frank Fritz Otto Ulrich Christoph Johannes Friedrich Georg Heinrich Kurt Ludwig François Jacques Michel "
        "Philippe Alain Bernard Nicolas Laurent Olivier Julien Antoine Guillaume Mathieu Thierry Christophe Stéphane Sébastien Frédéric Éric "
        "Gérard René André Claude Marcel Henri Yves Didier Hugo Théo Étienne José Javier Francisco Manuel Pedro Alejandro Diego Fernando Sergio "
        "Pablo Jorge Alberto Álvaro Andrés Rafael Raúl Rubén Enrique Ramón Vicente Ignacio Óscar Jesús Ángel Joaquín Giovanni Giuseppe Marco "
        "Luca Paolo Mario Francesco Matteo Lorenzo Mohammed Muhammad Mohamed Ahmed Ali Omar Hassan Ibrahim Yusuf Mehmet Mustafa Raj Amit "
        "Rahul Sanjay Vijay Ivan Sergei Dmitri Vladimir Boris Igor Nikolai Piotr Tomasz Krzysztof Jakub Erik Lars Nils Anders Björn Johan"
    ).split(),
    ("latin", "f"): (
        "Mary Anna Susan Linda Sarah Karen Laura Julia Emma Alice Ursula Heike Marie Claire Sophie Maria Carmen Lucia Isabel Elena "
        "Patricia Jennifer Elizabeth Barbara Jessica Lisa Nancy Betty Sandra Margaret Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa "
        "Deborah Stephanie Rebecca Sharon Cynthia Dorothy Amy Kathleen Angela Shirley Brenda Pamela Nicole Samantha Katherine Christine Helen "
        "Debra Rachel Carolyn Janet Catherine Heather Diane Olivia Julie Joyce Victoria Ruth Virginia Lauren Kelly Christina Joan Evelyn Judith "
        "Andrea Hannah Megan Cheryl Jacqueline Martha Madison Teresa Gloria Sara Janice Ann Anne Kathryn Abigail Sophia Frances Jean Judy Isabella "
        "Julia Charlotte Theresa Denise Marilyn Amber Danielle Brittany Diana Natalie Tiffany Alexis Kayla Lori Jane Lucy Ellen Eleanor Chloe "
        "Ella Mia Zoe Sabine Petra Monika Renate Brigitte Ingrid Helga Gisela Karin Claudia Susanne Birgit Martina Gabriele Angelika Silke Anja "
        "Katja Katrin Kerstin Nadine Stefanie Sandra Tanja Ute Ulrike Christa Elke Erika Hildegard Ilse Johanna Lena Leonie Greta Elisabeth "
        "Katharina Franziska Annette Nathalie Isabelle Sylvie Catherine Françoise Monique Valérie Céline Aurélie Camille Élise Hélène Juliette "
        "Émilie Chloé Manon Léa Inès Geneviève Jacqueline Martine Véronique Sandrine Florence Amélie Ana Cristina Pilar Dolores Josefa Rosa "
        "Teresa Ángela Lucía Sofía Paula Marta Raquel Beatriz Silvia Patricia Mónica Alicia Rocío Inés Julia Giulia Francesca Chiara Fatima "
        "Aisha Leila Layla Priya Anita Sunita Olga Natalia Irina Svetlana Tatiana Ekaterina Agnieszka Katarzyna Astrid Freya Sigrid"
    ).split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Александр Владимир Евгений Игорь Олег Юрий Виктор Павел Максим Артём Денис Антон Константин Борис Григорий Василий Роман Кирилл Илья Никита Георгий Фёдор".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана Екатерина Анастасия Юлия Людмила Галина Марина Надежда Валентина Лариса Нина Дарья Ксения Вера Алина Полина Оксана Виктория Софья Евгения Тамара".split(),
}
LAST = "Smith Johnson Williams Brown Jones Miller Davis Wilson Taylor Clark Müller Schmidt Schneider Fischer Weber Dubois Moreau Laurent García Martínez López Sánchez".split()
#: Surnames that are everyday words too; without a title or first name before them they are left.
WORDS = set(
    "Smith Brown Miller Taylor Clark Baker Cook Young King White Green Black Gray Grey Hill Wood Woods Stone Rice Bell Bush Ford Field Fields Fox "
    "Wolf Bird Fish Rose Lane Park Banks Bishop Page Price Long Short Strong Rich Wise Day May March Summer Winter Love Hope Grace Pope Prince "
    "Knight Church House Mason Carpenter Fisher Hunter Potter Cooper Butler Major Best Good Little Small Power Powers Rivers Waters West North "
    "Schmidt Schneider Fischer Weber Koch Klein Gross Lang Schwarz Weiß Braun Neumann Richter Bauer Wagner Becker Vogel Fuchs Berg Stein Sommer "
    "Petit Grand Blanc Noir Rouge Roi Boulanger Mercier Boucher Rey Rubio Moreno Blanco Bravo Herrero".split()
)
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora".split()

#: Surnames that are no everyday words, by which an unlisted first name is told.
SURNAMES = set(
    "Johnson Williams Jones Davis Wilson Taylor Thompson Robinson Anderson Jackson Harris Lewis Evans Roberts Campbell Murphy Kelly Sullivan "
    "Müller Schmitz Hoffmann Schulz Krüger Köhler Schröder Zimmermann Lehmann Dubois Moreau Laurent Lefebvre Girard Rousseau Fournier "
    "García Martínez López Sánchez Rodríguez Hernández González Pérez Gómez Díaz Ramírez Torres Garcia Martinez Lopez Sanchez Rodriguez Hernandez "
    "Gonzalez Perez Gomez Diaz Ramirez Silva Santos Oliveira Souza Ferreira Rossi Russo Bianchi Romano Ricci Esposito Colombo Novak Kowalski "
    "Patel Sharma Singh Kumar Gupta Khan Reddy Iyer Nair Banerjee Mukherjee Chatterjee Desai Mehta Joshi Verma Agarwal Rao Das Chowdhury "
    "Zhang Wang Chen Liu Huang Zhao Zhou Yang Xu Zhu Lin Guo Kim Park Choi Jung Nguyen Tran Pham Hoang Tanaka Suzuki Sato Takahashi Watanabe "
    "Yamamoto Nakamura Kobayashi Hussain Ahmed Ali Hassan Ibrahim Abdullah Rahman Haddad Okafor Adeyemi Mensah Osei Diallo Traoré Mbeki Dlamini "
    "Yılmaz Kaya Demir Cohen Levy Mizrahi Horvat Nagy Szabó Virtanen Korhonen Papadopoulos Popescu Ionescu Иванов Петров Сидоров Смирнов Кузнецов".split()
)
_SURNAME = re.compile(r"^(?:Mc|Mac|O['’])[A-Z]|\w{2,}(?:ński|wski|vski|vsky|ovsky|ewicz|owicz|vych|chuk|enko|oğlu|dóttir|sdottir|poulos|opoulou|idis|escu|vić|ović|ovic|evic|shvili|adze|zadeh|sson|nsen|ssen|ovna|ikov|ekov|akov|enkov|ova|eva|ская|ский|енко|ович|ова|ева)$")
#: Capitalised words that begin a sentence or a phrase, and are no first names.
STARTS = set(
    "The A An And Or But If In On At By For From To With Of As Is Are Was This That These Those My Our Your His Her Its Their All No Not New Old North South East West "
    "San Santa Saint St Mount Lake River Fort Port Los Las El La Le Les Der Die Das Den Dem Des Ein Eine Und Oder Im Am Zu Von Un Une Et Ou Du Au Y O En Con Por Para "
    "Dear Hello Hi Contact Ask Call Then Later Yesterday Today Tomorrow After Before When While Where Who What Why How Also Only General Public United University".split()
)
#: Words that name institutions, companies and places; a pair with one of them is no person unless a list has its first name.
INSTITUTIONS = set(
    "House Court Courts Bank Banks Times Corp Corporation Inc Incorporated Ltd Limited Llc Plc Gmbh Ag Company Group Holdings Industries Enterprises Partners Ventures "
    "Systems Technologies Technology Software Solutions Labs Laboratories Laboratory Airlines Airways Motors Motor Energy Oil Gas Steel Pharma Pharmaceuticals Insurance "
    "Capital Investments Securities Exchange Market Markets Trust Fund Foundation University College School Academy Institute Hospital Clinic Ministry Department Office "
    "Agency Council Committee Commission Congress Senate Parliament Government Cabinet Assembly Party Union Federation Association Society Organization Organisation League "
    "Club Team Army Navy Force Forces Corps Police Guard Service Services Bureau Administration Authority Board Center Centre Museum Library Theatre Theater Gallery Church "
    "Cathedral Temple Press Post News Journal Herald Tribune Gazette Guardian Telegraph Mirror Network Radio Television Channel Studios Records Media Magazine Books "
    "Street Road Avenue Lane Square Bridge Tower Building Park Gardens Station Airport Harbor Harbour Port Hotel Hill Hills Valley Mountain Mountains Island Islands Coast "
    "Bay Beach Lake River Ocean Sea Desert Forest City Town Village County District Province State States Kingdom Republic Empire Nation Nations Cross Watch Reserve "
    "Treasury Project Program Programme Campaign Movement Festival Conference Summit Award Awards Prize Cup Games Act Bill Law License Treaty Agreement Accord War "
    "Bundesbank Bundestag Bundesrat Ministerium Verein Gesellschaft Partei Zeitung Universität Banque Société Université Ministère Banco Universidad Ministerio Gobierno Partido".split()
)
CALENDAR = set(
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Week Weekend Month Year "
    "Day Night Morning Evening Afternoon Spring Summer Autumn Winter Christmas Easter Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Januar Februar März Mai "
    "Juni Juli Oktober Dezember Lundi Mardi Mercredi Jeudi Vendredi Samedi Dimanche Lunes Martes Miércoles Jueves Viernes Sábado Domingo".split()
)
#: Words before a noun; a pair that begins with one is no person.
QUALIFIERS = set(
    "American British English Scottish Irish Welsh Canadian Australian German French Italian Spanish Portuguese Dutch Swiss Austrian Swedish Norwegian Danish Finnish Polish "
    "Russian Ukrainian Turkish Greek Chinese Japanese Korean Indian Pakistani Iranian Iraqi Israeli Egyptian African Asian European Latin Mexican Brazilian Western Eastern "
    "Northern Southern Central International National Federal Royal Imperial Supreme High Grand Great Big Little First Second Third Last Next Former Late Early Best Top "
    "Global World Human Real Social Democratic Republican Liberal Conservative Labour Green Red Black White Blue Golden Silver Digital Modern Holy Sacred Upper Lower Inner "
    "Deutsche Deutscher Deutsches Deutschen Bayerische Süddeutsche Frankfurter Berliner Hong Sri Costa Puerto Buenos Monte Saudi Abu Tel Addis Kuala Wall Downing "
    "Manchester Liverpool Chelsea Arsenal Barcelona Bayern Silicon Capitol Scotland Red Human Many Most Some Every Each Both Other Another Several People Experts Critics "
    "Officials Investors Analysts Scientists Researchers Police Microsoft Google Apple Amazon Facebook Twitter Goldman Morgan Wells Lehman Merrill General".split()
)
#: Ranks and offices; the word behind one is a surname, the rank itself is nobody's name.
RANKS = set(
    "President Minister Chancellor Senator Congressman Congresswoman Governor Mayor Judge Justice Captain Colonel Major Lieutenant Sergeant Corporal Admiral Officer Detective "
    "Inspector Professor Doctor Sir Dame Lady Lord Queen King Prince Princess Pope Cardinal Archbishop Father Sister Brother Uncle Aunt Coach Secretary Ambassador Director "
    "Chairman Chairwoman Präsident Kanzler Kanzlerin Minister Ministerin Président Presidente Ministro".split()
)
#: What follows a name that is no person's, within a clause or so.
_THING = re.compile(r"\b(?:its|itself|profits?|shares?|revenues?|dividends?|shareholders|quarterly|the (?:company|bank|firm|team|club|agency|group|city|country|government|paper|newspaper|ministry|party|university|court))\b")
#: Verbs that persons are the subjects of.
_DOES = (
    "said|says|called|calls|asked|asks|told|tells|wrote|writes|replied|answered|emailed|phoned|texted|met|lives|lived|works|worked|signed|joined|resigned|retired|married|"
    "thinks|thought|believes|believed|wants|wanted|went|came|left|arrived|smiled|laughed|nodded|spoke|explained|agreed|stayed|moved|"
    "sagte|sagt|rief|schrieb|fragte|antwortete|wohnt|arbeitet|kam|ging|a dit|dit|écrit|habite|travaille|demanda|dijo|dice|escribió|vive|trabaja|preguntó|сказал|сказала|написал|написала|живёт"
)
_AFTER = re.compile(rf"(?:,? (?:who |and |et |und |y )?(?:{_DOES})|'s (?:wife|husband|phone|email|account|house|father|mother|son|daughter)| ?[<(][\w.+\-]+@|,? (?:born|aged) )(?!\w)")
_BEFORE = re.compile(
    r"(?i:(?:\bnames? (?:is|was)|\bname ?:|\bnamed|\bi am|\bi['’]m|\bi met|\bsigned(?: by)?[:,]?|\bwritten by|\bauthor ?:|\bcontact ?:?|\battn\.?:?|\bsincerely,|\bregards,|\byours,|\bdear|"
    r"\b(?:my|her|his) (?:wife|husband|friend|boss|doctor|son|daughter|brother|sister|mother|father|colleague)|\bpatient ?:?|\bcustomer ?:|\bclient ?:|"
    r"\bheiße|\bich bin|\bμε λένε|\bονομάζομαι|\bm['’]appelle|\bje suis|\bme llamo|\bsoy|\bменя зовут)\s{1,2})$"
)
_CLAUSE = re.compile(r"(?:^|[.!?;:\n\r])[\s\"'(\[]*$")
_ARTICLE = re.compile(r"(?i:(?:^|\W)(?:the|an?|der|die|das|dem|den|des|eine?[mnrs]?|le|la|les|une?|el|los|las|una) )$")

_LISTS = {(*k, n): names for n, lists in enumerate((FIRST, MORE)) for k, names in lists.items()}
_FIRST_OF = {n: k for k in reversed(_LISTS) for n in reversed(_LISTS[k])}  # the first list that has a name owns it
_POOLS = {k: tuple(n for n in dict.fromkeys(names) if _FIRST_OF[n] == k) for k, names in _LISTS.items()}
_UP, _LOW = ("".join(chr(c) for c in (*range(0x41, 0x180), *range(0x386, 0x3CF), *range(0x400, 0x460)) if unicodedata.category(chr(c)) == k) for k in ("Lu", "Ll"))
_ONE = rf"(?:(?:Mc|Mac|O['’]|D['’])?[{_UP}][{_LOW}]+)"
_CAP = rf"{_ONE}(?:-{_ONE})*"
_PARTICLE = r"(?:(?:von|van|zu|de|di|da|do|dos|der|den|del|della|la|le|bin|ibn|ben|al|el|ter|ten|af|av) |[A-Z]\. )*"
_NAME = re.compile(
    rf"(?<![\w'’\-])(?:(?P<title>{'|'.join(TITLES)})\.? (?:(?:{'|'.join(TITLES)})\.? )*(?P<tfirst>{_CAP} )?{_PARTICLE}(?P<tlast>{_CAP})|(?P<first>{_CAP}) {_PARTICLE}(?P<last>{_CAP}))(?![\w\-])"
)
_WORD = re.compile(rf"(?<![\w'’\-]){_CAP}(?![\w\-])")
_MAIL = re.compile(r"(?<![\w.%+\-])[\w.%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_BYTE = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_IPV4 = rf"(?:{_BYTE}\.){{3}}{_BYTE}"
_HEXES = r"[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})"
_END = r"(?!\d)(?![ .\-/]?\d{3})"  # not the beginning of a longer number
_TRUNK = "|".join(rf"0[1-9]\d{{1,4}}(?:{x}\d{{3,4}}){{1,2}}|0[1-9]\d{{1,4}}(?:{x}\d{{2,3}}){{1,4}}|0[1-9](?:{x}\d\d){{4}}" for x in (" ", r"\.", "-"))
_NUMBER = re.compile(
    rf"(?<![\w.])(?P<ipv4>{_IPV4})(?![\w]|\.\d)"
    rf"|(?<![\w:])(?P<ipv6>(?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}|(?:[0-9a-fA-F]{{1,4}}:){{6}}{_IPV4}"
    rf"|(?=[0-9a-fA-F:]*\d)(?:{_HEXES}{{0,6}})?::(?:(?:[0-9a-fA-F]{{1,4}}:){{0,5}}{_IPV4}|{_HEXES}{{0,6}})?)(?![\w:]|\.\d)"
    r"|(?<![\w\-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w\-])"
    r"|(?P<phone>(?<![\w+])\+1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)"  # +1 (202) 555-0123
    r"|(?<![\w+])\+[1-9](?:[ .\-/]?(?:\(\d{1,4}\)|\d)){6,14}(?!\d)"  # any other E.164 number
    r"|(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?|\d{1,4}[ .\-])\d{2,4}(?:[ .\-]?\d{2,4}){1,3}(?!\d)"
    r"|(?<![\w\-])(?:1[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\d)"
    r"|(?<![\w\-])(?<!\d[ .])(?:1[ .\-])?\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\w\-])"
    r"|(?<![\w\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])"
    rf"|(?<!\w)\(0\d{{1,5}}\)[ .\-/]?\d{{2,9}}(?:[ .\-/]?\d{{2,9}}){{0,3}}{_END}"  # (030) 1234567
    rf"|(?<![\w.,/\-])(?:0[1-9]\d{{1,4}}[ \-/]\d{{5,9}}|(?=(?:[ .\-]?\d){{9}})(?:{_TRUNK})){_END})"  # 0151 12345678
    r"|(?<![0-9])(?P<card>\d(?:[ \-]?\d){12,18})(?![0-9])"
)
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?P<secret>[0-9a-fA-F]{32,})(?![0-9A-Za-z])|(?<!\w)(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)")

#: Openings of access keys that services publish for scanners; they are kept.
KEY_STARTS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "sk_live_", "sk_test_", "xoxb-", "xoxp-")
_KEY = re.compile(rf"(?<![0-9A-Za-z])(?:{'|'.join(KEY_STARTS)})[0-9A-Za-z_\-]{{10,}}(?![0-9A-Za-z_\-])")
_CALLED = re.compile(r"(?i:password|passwd|passphrase|pwd|secret|token|api[_\-]?key|access[_\-]?key)[\"']?[ \t]?$")
_VALUE = re.compile(r"[ \t]?[\"']?([^\s\"']{4,})(?![^\s\"'])")
_BEARER = re.compile(r"(?i:\bbearer) (?P<token>[A-Za-z0-9\-._~+/]{16,}=*)(?![A-Za-z0-9])")
_NAMED_SSN = re.compile(r"(?i:\bssn|\bsocial security (?:number|no\.?))[:#]? {0,2}(?P<ssn>\d{3} \d{2} \d{4})(?!\d)")
_AROUND = ".,;:!?)]}#*$%&|<>"

_DIGIT = re.compile("[0-9]")
#: A capitalised word before another one, where a name can begin; it starts with a class, which the engine looks for fast.
_START = re.compile(rf"[{_UP}](?<![\w'’\-](?s:.))[\w'’\-]+\.? (?={_PARTICLE}[{_UP}])")


@dataclass(frozen=True)
class Entity:
    kind: str
    start: int
    stop: int
    text: str


def _secret(value: str, sign: str) -> bool:
    """Whether what stands behind the sign can be a secret: short values need a digit, and so do all after a colon."""
    return bool(_DIGIT.search(value)) or sign == "=" and len(value) >= 6


def _credentials(text: str) -> Iterator[Entity]:
    """What is set as a password or token; after a colon, only if a digit is in it."""
    for sign in "=:":
        at, plain = text.find(sign), 0  # up to `plain` a run has no digit
        while at >= 0:
            past = at + 1
            if (sign == "=" or at >= plain) and _CALLED.search(text[max(0, at - 16) : at]) and (m := _VALUE.match(text, at + 1)):
                value = m[1].rstrip(_AROUND)
                if len(value) >= (4 if sign == "=" else 6) and _secret(value, sign):
                    yield Entity("credential", m.start(1), m.start(1) + len(value), value)
                    past = m.start(1) + len(value)
                elif sign == ":":
                    plain = m.start(1) + len(value)
            at = text.find(sign, past)


def _institution(word: str) -> bool:
    return word in INSTITUTIONS or word.removesuffix("s") in INSTITUTIONS


def _is_person(text: str, m: re.Match) -> bool:
    """Whether two capitalised words are a person's name: by a list, by an ending, or by what stands around them."""
    first, last = m["first"], m["last"]
    if last in TITLES or first == last or last in _FIRST_OF and first not in _FIRST_OF:  # a word said twice, or the name begins with the second
        return False
    if first in _FIRST_OF or first.split("-")[0] in _FIRST_OF:
        return True
    if first in STARTS or last in STARTS or {first, last} & CALENDAR or first in QUALIFIERS or _institution(first) or first in RANKS:
        return False
    before = text[max(0, m.start() - 24) : m.start()]
    if _institution(last) or _ARTICLE.search(before):
        return False
    if last in SURNAMES or _SURNAME.search(last):
        return True
    if _BEFORE.search(before):
        return True
    if not (after := _AFTER.match(text, m.end())):
        return False
    return not after.group().lstrip(",").strip()[:1].isalpha() or not _THING.search(text, m.end(), m.end() + 160)  # a verb alone must not speak for a thing


def _ranked(text: str, m: re.Match) -> bool:
    """Whether a rank stands before a person's surname: "President Obele said"."""
    last = m["last"]
    if m["first"] not in RANKS or last in RANKS or last in STARTS or _institution(last) or last in CALENDAR or last in QUALIFIERS:
        return False
    return last in SURNAMES or bool(_SURNAME.search(last) or _AFTER.match(text, m.end()))


def _names(text: str) -> Iterator[Entity]:
    """Names of persons; a pair that is none gives its second word back to the search."""
    at = 0
    for start in _START.finditer(text):
        if start.start() < at or not (m := _NAME.match(text, start.start())):
            continue
        if m["title"]:
            if m["tfirst"]:
                yield Entity("first", m.start("tfirst"), m.end("tfirst") - 1, m["tfirst"][:-1])
            yield Entity("last", m.start("tlast"), m.end("tlast"), m["tlast"])
        elif _is_person(text, m):
            yield Entity("first", *m.span("first"), m["first"])
            yield Entity("last", *m.span("last"), m["last"])
        elif _ranked(text, m):
            yield Entity("last", *m.span("last"), m["last"])
        else:
            continue
        at = m.end()


#: Introductions in scripts without capitals, and what a name is made of there.
_CASELESS = [
    (("我叫", "我的名字是", "我的名字叫"), re.compile(r"\s?([\u4e00-\u9fff]{2,4})(?=[，。,.!！、\s]|$)"), False),
    (("名前は", "なまえは"), re.compile(r"\s?([\u4e00-\u9fff\u3041-\u30fa\u30fc]{2,10}?)(?=です|と申し|といい|と言い)"), False),
    (("이름은",), re.compile(r"\s?([\uac00-\ud7a3]{2,4}?)(?=입니다|이에요|예요|이라고|라고)"), False),
    (("اسمي", "إسمي"), re.compile(r"\s([\u0621-\u064a]{2,}(?: [\u0621-\u064a]{2,}){0,2})(?![\u0621-\u064a])"), True),
    (("नाम",), re.compile(r"\s([\u0900-\u0963]{2,}(?: [\u0900-\u0963]{2,}){0,2}?)(?= है| हैं|।)"), True),
]


def _introduced(text: str) -> Iterator[Entity]:
    """Names behind an introduction in a script without capitals, and their other mentions."""
    for words, name, parted in _CASELESS:
        known: set[str] = set()
        for w in words:
            at = text.find(w)
            while at >= 0:
                if m := name.match(text, at + len(w)):
                    known |= set(m[1].split(" ")) if parted else {m[1]}
                at = text.find(w, at + len(w))
        for k in sorted(known, key=lambda k: (-len(k), k)):
            at = text.find(k)
            while at >= 0:
                stop = at + len(k)
                if not parted or not (text[at - 1 : at].isalpha() or text[stop : stop + 1].isalpha()):
                    yield Entity("last", at, stop, k)
                at = text.find(k, stop)


def _means_person(text: str, m: re.Match) -> bool:
    """Whether an everyday word that is also a known person's name means the person here.

    Inside a clause a capital tells, unless an article stands before; where a
    clause begins, a verb that persons are the subjects of, or a possessive.
    """
    if m.group() not in WORDS:
        return True
    before = text[max(0, m.start() - 24) : m.start()]
    if _CLAUSE.search(before):
        return bool(_AFTER.match(text, m.end()) or re.match(r" \w+ed\b|['’]s\b", text[m.end() : m.end() + 24]))
    return not _ARTICLE.search(before)


def detect(text: str) -> list[Entity]:
    """Entities of a text, in order, without overlaps; the first pattern to claim a place has it."""
    found: list[Entity] = []
    at = text.find("@")
    while at >= 0:
        left, right = at, at
        while left and not text[left - 1].isspace():
            left -= 1
        while right < len(text) and not text[right].isspace():
            right += 1
        found += [Entity("email", left + m.start(), left + m.end(), m.group()) for m in _MAIL.finditer(text[left:right])]
        at = text.find("@", right)
    digit = _DIGIT.search(text)
    while digit:  # line by line, where there are digits
        left = text.rfind("\n", 0, digit.start()) + 1
        right = text.find("\n", digit.start())
        right = len(text) if right < 0 else right
        for pattern in (_NUMBER, _SECRET, _NAMED_SSN):
            for m in pattern.finditer(text, left, right):
                if m.lastgroup != "card" or not m.group().isdigit() or luhn(m.group()[:-1]) == int(m.group()[-1]):
                    found.append(Entity(m.lastgroup, *m.span(m.lastgroup), m[m.lastgroup]))
        digit = _DIGIT.search(text, right)
    if any(x in text for x in KEY_STARTS):
        found += [Entity("key", m.start(), m.end(), m.group()) for m in _KEY.finditer(text)]
    found += _credentials(text)
    if "earer " in text or "EARER " in text:
        found += [Entity("credential", *m.span("token"), m["token"]) for m in _BEARER.finditer(text) if _DIGIT.search(m["token"])]
    if not text.isascii():
        found += _introduced(text)
    named = list(_names(text))
    if named:
        found += named
        known = {e.text: e.kind for e in named}  # the same persons by one name
        found += [Entity(known[m.group()], m.start(), m.end(), m.group()) for m in _WORD.finditer(text) if m.group() in known and _means_person(text, m)]
    found.sort(key=lambda e: (e.start, -e.stop))
    out: list[Entity] = []
    for e in found:
        if not out or e.start >= out[-1].stop:
            out.append(e)
    return out


def canonical(e: Entity) -> str:
    """One spelling for all mentions of an entity."""
    if e.kind in ("email", "ipv6"):
        return e.text.lower()
    if e.kind in ("card", "phone", "iban"):
        return re.sub(r"[^0-9A-Za-z+]", "", e.text)
    return e.text


# ------------------------------------------------------------- permutations


def _permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of ``range(size)``: a Feistel network with cycle walking."""
    if size <= 1:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    steps = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    width = (half + 7) // 8
    while True:
        a, b = value >> half, value & mask
        for r in steps:
            if back:
                a, b = b, a
            h = hashlib.blake2b(f"{tweak}|{size}|{r}|".encode() + b.to_bytes(width, "big"), key=key, digest_size=min(64, width + 8))
            f = int.from_bytes(h.digest(), "big") & mask if width <= 56 else int.from_bytes(hashlib.shake_256(h.digest()).digest(width), "big") & mask
            a ^= f
            if not back:
                a, b = b, a
        value = (a << half) | b
        if value < size:
            return value


_ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7),
    "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7),
    "".join(chr(c) for c in range(0x430, 0x450)),
    "".join(chr(c) for c in range(0x410, 0x430)),
    "".join(chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2),
    "".join(chr(c) for c in range(0x391, 0x3AA) if c != 0x3A2),
]
_OWN = {c: a for a in _ALPHABETS for c in a}
_HEX_MIXED = {c: a for a in ("0123456789", "abcdef", "ABCDEF") for c in a}
_HEX_LOWER, _HEX_UPPER = ({c: a for c in a} for a in ("0123456789abcdef", "0123456789ABCDEF"))
_VOWELS = ("aeiou", "AEIOU", "аеиоуыэюя", "АЕИОУЫЭЮЯ")
_CONSONANTS = ("bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ", "бвгджзклмнпрстфхцчшщ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ")
#: Consonants that may take each other's place next to another one, so that a name can still be spoken.
_ALIKE = {c: a for low in ("lr", "mn", "bcdgkpqt", "fhjsvwxyz", "лр", "мн", "бвгдзкпт", "жсфхцчшщ") for a in (low, low.upper()) for c in a}
_VOWEL, _CONSONANT = ({c: a for a in part for c in a} for part in (_VOWELS, _CONSONANTS))
#: Endings that tell a name's gender; they stay.
_GENDER = re.compile(r"(?<=\w\w)(?:[оеё]ва|ина|ская|ская|ский|[оеё]в|ин|енко|[ая]|a)$")

Slots = list[tuple[int, str]]


@functools.lru_cache(maxsize=1 << 14)
def _alphabet(c: str) -> str:
    """What a letter or digit of any script may become: the like of its kind in its part of the code table."""
    if c in _OWN:
        return _OWN[c]
    kind = unicodedata.category(c)
    if kind[0] != "L" and kind != "Nd":
        return c
    start = ord(c) & ~127
    return "".join(chr(p) for p in range(start, start + 128) if unicodedata.category(chr(p)) == kind and chr(p) not in _OWN)


def _slots(text: str, of: Callable[[str], str] = _alphabet) -> Slots:
    """The places of a text that can change, and what each can become."""
    return [(i, a) for i, c in enumerate(text) if len(a := of(c)) > 1]


def _name_slots(name: str) -> Slots:
    """The same for a name: vowels stay vowels, clusters can be spoken, the ending of its gender stays."""
    end = m.start() if (m := _GENDER.search(name)) else len(name)
    out = []
    for i, c in enumerate(name[:end]):
        a = _VOWEL.get(c)
        if a is None and c in _CONSONANT:
            cluster = any(x.lower() in _CONSONANT for x in name[max(0, i - 1) : i] + name[i + 1 : i + 2])
            a = _ALIKE[c] if cluster else _CONSONANT[c]
        a = _alphabet(c) if a is None else a
        if len(a) > 1:
            out.append((i, a))
    return out


def _spell_long(text: str, slots: Slots, key: bytes, tweak: str, back: bool) -> str:
    """``_spell`` in linear time: each half is shifted, letter by letter, by a stream that the other half keys."""
    sizes = np.array([len(a) for _, a in slots], dtype=np.int64)
    value = np.array([a.index(text[i]) for i, a in slots], dtype=np.int64)
    pattern = hashlib.blake2b("".join(a[0] for _, a in slots).encode(), digest_size=32).digest()
    half = len(slots) // 2
    parts = (slice(None, half), slice(half, None))
    for r in range(LONG_ROUNDS - 1, -1, -1) if back else range(LONG_ROUNDS):
        own, other = parts[r % 2], parts[1 - r % 2]
        seed = hashlib.blake2b(f"{tweak}|long|{r}|".encode() + pattern + value[other].astype("<u2").tobytes(), key=key).digest()
        n = len(value[own])
        move = np.frombuffer(hashlib.shake_256(seed).digest(4 * n), dtype="<u4").astype(np.int64) % sizes[own]
        value[own] = (value[own] + (-move if back else move)) % sizes[own]
    out = list(text)
    for (i, a), k in zip(slots, value.tolist(), strict=True):
        out[i] = a[k]
    return "".join(out)


def _spell(text: str, slots: Slots, key: bytes, tweak: str, back: bool) -> str:
    """Permute all texts of the same pattern: each character stays in its alphabet."""
    if len(slots) > LONG:
        return _spell_long(text, slots, key, tweak, back)
    value, size = 0, 1
    for i, a in slots:
        value, size = value * len(a) + a.index(text[i]), size * len(a)
    pattern = "".join(a[0] for _, a in slots)
    value = _permute(value, size, key, f"{tweak}|{pattern}", back)
    out = list(text)
    for i, a in reversed(slots):
        value, k = divmod(value, len(a))
        out[i] = a[k]
    return "".join(out)


def placeholder(kind: str, value: str, key: bytes) -> str:
    """What stands for a value that has no free surrogate: its kind and 80 keyed bits, or for names an invented one of 16 letters."""
    h = hashlib.blake2b(f"{kind}|{value}".encode(), key=key, digest_size=10).digest()
    if kind == "email":
        return f"{h.hex()}@mail.invalid"
    if kind not in ("first", "last"):
        return f"[{kind}-{h.hex()}]"
    n, out = int.from_bytes(h, "big"), ""
    consonants, vowels = ("бвгдзклмнпрст", "аеио") if value[:1] in _OWN and "\u0400" <= value[0] else ("bdfgklmnprstv", "aeio")
    while len(out) < 16:
        n, k = divmod(n, len(consonants) * len(vowels))
        out += consonants[k // len(vowels)] + vowels[k % len(vowels)]
    return out.capitalize() + (m.group() if (m := _GENDER.search(value)) else "")


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


@functools.lru_cache(maxsize=64)
def _cycle(pool: tuple[str, ...], key: bytes) -> dict[str, str]:
    order = sorted(pool, key=lambda n: hashlib.blake2b(n.encode(), key=key).digest())
    return dict(zip(order, order[1:] + order[:1], strict=True))


def surrogate(kind: str, value: str, key: bytes, draw: int = 0, back: bool = False) -> str:
    """The surrogate of a canonical value; ``back`` undoes it.  A value in which nothing can change has a placeholder."""
    tweak = f"{kind}|{draw}"

    def spell(text: str, more: str = "", slots: Slots | None = None) -> str:
        return _spell(text, _slots(text) if slots is None else slots, key, tweak + more, back)

    if kind == "email":
        m = re.fullmatch(r"(.*?)(\.example\.(?:com|org|net)|\.[a-z]{2,})", value, re.DOTALL)
        return spell(m[1], m[2]) + m[2] if _slots(m[1]) else placeholder(kind, value, key)
    if kind == "ipv4":
        a, b, c, d = map(int, value.split("."))
        n = (a << 24) | (b << 16) | (c << 8) | d
        low, size = (1 << 24, 223 << 24) if 1 <= a <= 223 else (224 << 24, 32 << 24) if a else (0, 1 << 24)
        n = low + _permute(n - low, size, key, tweak, back)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        head, rest = value[0], value[1:]
        if luhn(value[:-1]) == int(value[-1]):
            body = spell(rest[:-1], head)
            return head + body + str(luhn(head + body))
        while True:
            rest = spell(rest, f"{head}x")
            if luhn(head + rest[:-1]) != int(rest[-1]):
                return head + rest
    if kind == "phone" and value.startswith("+"):
        return value[:2] + spell(value[2:], value[:2])
    if kind == "phone":  # a trunk 0 stays, and no other number gets one
        if value[0] == "0":
            return "0" + spell(value[1:], "0")
        while True:
            value = spell(value)
            if value[0] != "0":
                return value
    if kind == "iban":
        return value[:2] + spell(value[2:], value[:2])
    if kind == "key":
        start = next(x for x in KEY_STARTS if value.startswith(x))
        return start + spell(value[len(start) :], start) if _slots(value[len(start) :]) else placeholder(kind, value, key)
    if kind == "ipv6" and "." in value:  # the last four bytes in decimal
        head, tail = value.rsplit(":", 1)
        return spell(head, ".", _slots(head, lambda c: _HEX_LOWER.get(c, c))) + ":" + surrogate("ipv4", tail, key, draw, back)
    if kind in ("secret", "ipv6"):
        of = _HEX_LOWER if value == value.lower() else _HEX_UPPER if value == value.upper() else _HEX_MIXED
        slots = _slots(value, lambda c: of.get(c, c))
        return spell(value, "", slots) if slots else placeholder(kind, value, key)
    if kind in ("first", "last"):
        if pool := _pool(kind, value):
            turn = _cycle(pool, key)
            return {v: k for k, v in turn.items()}[value] if back else turn[value]
        if not _name_slots(value):
            return placeholder(kind, value, key)
        while True:
            value = spell(value, "", _name_slots(value))
            if not _pool(kind, value):
                return value
    return spell(value) if _slots(value) else placeholder(kind, value, key)


def _pool(kind: str, value: str) -> tuple[str, ...] | None:
    """The names that a listed name trades places with."""
    if kind == "first":
        return _POOLS[_FIRST_OF[value]] if value in _FIRST_OF else None
    return tuple(LAST) if value in LAST else None


def rendered(e: Entity, new: str) -> str:
    """The surrogate in the spelling of this mention: its separators and case."""
    if e.kind in ("card", "phone", "iban") and new[0] != "[":
        left = iter(new)
        return "".join(next(left) if re.match(r"[0-9A-Za-z+]", c) else c for c in e.text)
    if e.kind == "ipv6" and e.text == e.text.upper() and new[0] != "[":
        return new.upper()
    return new


def replace(text: str, key: bytes, changed: dict[tuple[str, str], str]) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with surrogates, and (kind, start, stop, surrogate) of every entity in ``text``."""
    parts, spans, at = [], [], 0
    for e in detect(text):
        value = canonical(e)
        new = rendered(e, changed.get((e.kind, value)) or surrogate(e.kind, value, key))
        parts += [text[at : e.start], new]
        spans.append((e.kind, e.start, e.stop, new))
        at = e.stop
    return "".join([*parts, text[at:]]), spans


# ------------------------------------------------------------------- Spark

def _listed() -> Column:
    """Names that trade places within a list; only distinctness can hold there."""
    return ((F.col("kind") == "first") & F.col("value").isin(*_FIRST_OF)) | ((F.col("kind") == "last") & F.col("value").isin(*LAST))


def key_of(spark) -> bytes:
    """The key that ``corpusloom.pii.key`` sets; without it a random one, the same throughout the session."""
    key = spark.conf.get("corpusloom.pii.key", None)
    if not key:
        warnings.warn("corpusloom.pii.key is not set: surrogates will differ from session to session", stacklevel=2)
        key = _session_key(spark.sparkContext.applicationId)
    return hashlib.blake2b(key.encode(), digest_size=32).digest()


@functools.cache
def _session_key(application: str) -> str:
    return secrets.token_hex(32)


def _map(df: DataFrame, schema: str, f: Callable[[tuple], Iterator[tuple]]) -> DataFrame:
    kinds = T._parse_datatype_string(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for b in batches:
            rows = [r for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in f(row)]
            cols = list(zip(*rows, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def entities(docs: DataFrame, key: bytes) -> DataFrame:
    """Distinct (kind, value, drawn) of the corpus."""

    def find(row):
        seen = {(e.kind, canonical(e)) for e in detect(row[0] or "")}
        return ((k, v, surrogate(k, v, key)) for k, v in seen)

    return _map(docs.select("text"), "kind string, value string, drawn string", find).distinct()


def redraw(known: DataFrame, key: bytes, draws: int = DRAWS) -> DataFrame:
    """(kind, value, drawn) for entities of ``known`` whose first surrogate is taken.

    A draw is free if it is no entity, no first surrogate of one, and no other
    new draw; of entities that draw the same the least has it.  After ``draws``
    rounds the rest get placeholders.
    """
    checked = known.where(~_listed())
    values = known.select("kind", F.col("value").alias("drawn"))
    open_ = cut(checked.join(values, ["kind", "drawn"], "left_semi").select("kind", "value"))
    done = open_.select("kind", "value", F.lit("").alias("drawn")).limit(0)
    for draw in range(1, draws + 1):
        if open_.isEmpty():
            return done
        tried = _map(open_, "kind string, value string, drawn string", lambda row, draw=draw: [(row[0], row[1], surrogate(row[0], row[1], key, draw))])
        for taken in (values, known.select("kind", "drawn"), done.select("kind", "drawn")):
            tried = tried.join(taken, ["kind", "drawn"], "left_anti")
        won = tried.groupBy("kind", "drawn").agg(F.min("value").alias("value")).select("kind", "value", "drawn")
        done = cut(done.unionByName(won))
        open_ = cut(open_.join(done, ["kind", "value"], "left_anti"))
    rest = _map(open_, "kind string, value string, drawn string", lambda row: [(row[0], row[1], placeholder(row[0], row[1], key))])
    return done.unionByName(rest)


def anonymise(docs: DataFrame, key: bytes, name: str = "entities", keep_text: bool = True) -> DataFrame:
    """``docs`` with surrogates in ``text`` and one more column, the spans replaced."""
    known = cut(entities(docs, key))
    changes = cut(redraw(known, key))
    n, chars = changes.agg(F.count("*"), F.coalesce(F.sum(F.length("value") + F.length("drawn")), F.lit(0))).first()
    kind = T._parse_datatype_string("array<struct<kind:string,start:int,stop:int,surrogate:string>>")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    at = docs.columns.index("text")
    width, names = len(docs.columns), [f.name for f in schema.fields]
    own, table = None, docs.sparkSession.sparkContext.broadcast({})
    source = docs
    if n > BROADCAST_ROWS or chars > BROADCAST_CHARS:
        own = fresh(docs, "changes")
        source = _with_changes(docs, changes, own)
    elif n:  # at most BROADCAST_ROWS and BROADCAST_CHARS
        table = docs.sparkSession.sparkContext.broadcast({(r[0], r[1]): r[2] for r in changes.collect()})

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            extra = b.column(width).to_pylist() if own else None
            texts, spans = [], []
            for i, t in enumerate(b.column(at).to_pylist()):
                more = {(x["kind"], x["value"]): x["drawn"] for x in extra[i] or ()} if own else table.value
                new, found = (None, []) if t is None else replace(t, key, more)
                texts.append(new)
                spans.append([dict(zip(("kind", "start", "stop", "surrogate"), s, strict=True)) for s in found])
            cols = list(b.columns[:width])
            cols[at] = pa.array(texts, b.column(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, to_arrow_type(kind))], names)

    return source.mapInArrow(run, schema)


def _with_changes(docs: DataFrame, changes: DataFrame, own: str) -> DataFrame:
    """``docs`` with the changed draws that each of them needs, by joins.

    Documents are told by a hash of id and text; documents that share a hash
    get each other's draws too, which are the same for all of them.
    """
    mark = F.xxhash64("doc_id", "text")
    key, count = fresh(docs, "mark"), len(docs.columns)
    needed = _map(
        docs.select(mark.alias("mark"), "text"),
        "mark long, kind string, value string",
        lambda row: ((row[0], k, v) for k, v in {(e.kind, canonical(e)) for e in detect(row[1] or "")}),
    )
    lists = needed.join(changes, ["kind", "value"]).groupBy(F.col("mark").alias(key)).agg(
        F.collect_set(F.struct("kind", "value", "drawn")).alias(own)  # no more than one document's entities
    )
    marked = docs.withColumn(key, mark)
    return marked.join(lists, key, "left").select(*[marked[c] for c in docs.columns[:count]], own)


def pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """The query over all of ``documents``: the new text and what was replaced."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = anonymise(docs, key_of(spark))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.col("entities.kind"))), ",")
    return done.select("doc_id", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"), "text")
