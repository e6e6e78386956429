"""Labelled blocks of text for learning what is not natural prose, made at random from small word lists."""

from __future__ import annotations

import base64
import random

from millrace.llm.sentence_seeds import COMMA, COUNTED, FILES, GERMAN_MONTHS, LABELLED, MONTHS, NAMES, SEEDS, STARTERS, TITLES

# Short noun phrases by language, as they stand in lists and cells.
PHRASES = {
    "en": ["garden gate", "Notes on the river", "Boat and harbour", "winter coat", "Old bridge manual", "tea: green", "lamp oil", "Bread and butter", "Train ticket guide (12)", "market day"],
    "de": ["Herbststurm", "Landschlüssel", "Rechtschrift", "Gartentor", "Brotpreis", "Wintermantel / Hut", "Fahrplan", "Lampe: alt", "Brücke"],
    "fr": ["porte du jardin", "prix du pain", "manteau d'hiver", "lampe / huile", "vieux pont"],
    "es": ["puerta del jardín", "precio del pan", "abrigo", "lámpara / aceite", "puente viejo"],
    "pt": ["portão do jardim", "preço do pão", "casaco", "lâmpada: velha", "ponte velha"],
    "el": ["πόρτα", "τιμή ψωμιού", "παλτό / καπέλο", "γέφυρα"],
    "ar": ["باب البستان", "سعر الخبز", "معطف", "جسر / نهر"],
    "ur": ["باغ کا در", "روٹی کی قیمت", "پل", "چراغ"],
    "hi": ["बगीचे का द्वार", "रोटी का दाम", "पुल / नदी", "दीपक"],
    "am": ["የአትክልት በር", "ዳቦ", "ድልድይ", "መብራት / ዘይት"],
    "hy": ["այգու դուռ", "հացի գին", "կամուրջ", "լամպ"],
    "ko": ["정원 문", "빵 값", "다리 / 강", "등불"],
    "ja": ["庭の門", "パンの値段", "橋 / 川", "灯"],
    "zh": ["花园大门", "面包价格", "旧桥 / 河", "灯油"],
    "th": ["ประตูสวน", "ราคาขนมปัง", "สะพาน", "ตะเกียง / น้ำมัน"],
}
# Further sentences, with long runs of consonants.
FURTHER = {"de": ["Die Herbststürme am Landschlösschen kamen mit Angstschrei und Wirtschaftskrise.", "Das Rechtschreibbuch und der Kirschschnaps liegen beim Haupteingangsschlüssel.", "Der Entschluss zur Wahlschlacht fiel am Nachmittagsspaziergang."]}
# Words of page menus, of advertising, and of programs in several languages.
MENU = ["Overview", "Products", "Pricing", "Blog", "Careers", "Register", "Subscribe", "Privacy policy", "Terms of use", "Sitemap", "Account", "Basket", "Previous", "Settings", "Read more", "About us", "Imprint", "Downloads", "English", "Follow us"]
SHOUTS = ["Order today", "Limited offer", "Half price", "Free gift", "Call us", "Only this week", "You have won", "Save big", "Cheap watches", "Work from home", "Lose weight fast", "Get rich", "Click to claim", "Hot deals", "Act fast", "Money back"]
STYLES = ["margin", "padding", "color", "border", "width", "font-size", "display", "background", "line-height", "top"]
HEADERS = ["Content-Type", "Accept", "Host", "User-Agent", "Cache-Control", "ETag", "Server", "Vary", "Connection", "Age"]
LANGS = sorted(SEEDS)
_OPENERS = frozenset(STARTERS.split())
UNSPACED = ("zh", "ja", "th", "lo")


class Maker:
    """Blocks of one random state."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def made_up(self, like: str) -> str:
        """A word that no list holds: syllables in Latin script, else the letters of ``like`` in another order."""
        if not like.isascii():
            return "".join(self.r.sample(like, len(like)))
        word = "".join(self.r.choice("bcdfghlmnprstv") + self.r.choice(["", "", "", "r", "l"]) + self.r.choice(["a", "e", "i", "o", "u", "ea", "ou"]) + self.r.choice(["", "", "n", "r", "s", "st", "ck"]) for _ in range(self.r.randint(1, 4)))
        return word.capitalize() if like[0].isupper() else word

    def word_of(self, lang: str) -> str:
        """A word, or in a script without blanks a few letters, of the training sentences; some are made up."""
        word = self._word_of(lang)
        return self.made_up(word) if len(word) > 3 and lang not in UNSPACED and self.r.random() < 0.5 else word

    def _word_of(self, lang: str) -> str:
        while True:
            text = self.r.choice(SEEDS[lang])
            if lang in UNSPACED:
                at = self.r.randrange(max(1, len(text) - 5))
                word = "".join(c for c in text[at : at + self.r.randint(2, 5)] if c.isalpha() or 0x0E30 < ord(c) < 0x0E4F)
            else:
                word = self.r.choice(text.split(" ")).strip(".,;:!?\"'“”«»()„‘’–—¿¡।։።۔؟॥…`")
            if len(word) >= 2 and "{" not in word and "}" not in word:
                return word

    def phrase(self, lang: str) -> str:
        if lang in PHRASES and self.r.random() < 0.4:
            return self.r.choice(PHRASES[lang])
        glue = "" if lang in UNSPACED else " "
        one = glue.join(self.word_of(lang) for _ in range(self.r.choice([1, 2, 2, 3])))
        return one.capitalize() if self.r.random() < 0.3 else one

    def ident(self) -> str:
        return self.r.choice(["raw", "old", "tmp", "x", "fact", "base"]) + "_" + self.noun() + self.r.choice(["", "_v2", "_daily", "_all"])

    def noun(self) -> str:
        """A name as code has them."""
        if self.r.random() < 0.25:
            return self.r.choice(["x", "i", "n", "a", "b", "key", "val", "tmp", "idx", "buf", "src", "dst", "out", "arg", "ptr", "os", "sys", "db", "main", "print", "len", "self", "size", "data"])
        word = self.word_of("en").lower()
        return word if word.isalpha() and len(word) > 3 and word not in _OPENERS else self.r.choice(["maps", "boats", "trees", "lamps", "birds"])

    def item(self, lang: str) -> str:
        x = self.r.random()
        if x < 0.15:
            return self.ident()
        one = self.phrase(lang)
        if x < 0.27:
            one += (" and " if lang == "en" else " / ") + self.phrase(lang)
        elif x < 0.35:
            one += ": " + self.phrase(lang)
        elif x < 0.43:
            one += f" ({self.r.randint(2, 900)})"
        return one

    def cell(self, lang: str) -> str:
        x = self.r.random()
        if x < 0.3:
            return str(self.r.randint(0, 900))
        if x < 0.5:
            return f"{self.r.uniform(0, 40):.1f}"
        if x < 0.56:
            return ""
        if x < 0.6:
            return "n/a"
        return self.ident() if x < 0.75 else self.phrase(lang)

    def sentence(self, lang: str) -> str:
        s = self.r.choice(SEEDS[lang] + FURTHER.get(lang, []) * 3)
        if lang not in UNSPACED:
            rate = self.r.choice([0.2, 0.6, 0.9, 1.0])
            s = " ".join((self.made_up(w) if self.r.random() < 0.7 else self._word_of(lang)) if w.isalpha() and w.islower() and len(w) > 3 and self.r.random() < rate else w for w in s.split(" "))
        while "{" in s:
            a, b = s.index("{"), s.index("}")
            slot = s[a + 1 : b]
            many = {"N": NAMES, "i": "ABCDEFG", "f": FILES, "T": TITLES, "R": COUNTED, "m": MONTHS, "M": GERMAN_MONTHS, "L": LABELLED}.get(slot)
            if many:
                value = self.r.choice(many)
            elif slot == "F":
                value = self.ident()
            else:
                value = f"{self.r.uniform(0, 40):.1f}".replace(".", "," if lang in COMMA else ".") if slot == "x" else str(self.r.randint(1, 300))
            s = s[:a] + value + s[b + 1 :]
        return s

    def prose(self, lang: str) -> str:
        glue = "" if lang in ("zh", "ja") else self.r.choice([" ", " ", " ", " ", "  "])
        some = [self.sentence(lang) for _ in range(self.r.choice([1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 30, 120]))]
        if lang not in UNSPACED and self.r.random() < 0.08:
            # Documentation and licences: quoted and marked words, references, capitals, indented lines.
            words = [w for s in some for w in [*s.split(" ")[:-1], s.split(" ")[-1] + ("" if glue == " " else " ")]]
            for k in range(len(words)):
                if self.r.random() < 0.12:
                    words[k] = self.r.choice(["`{}`", '"{}"', "{}()", "({})", "'{}'", "<{}>", "*{}*", "{}/or"]).format(self.r.choice([words[k].strip(".,"), self.ident()]))
            lines, wide = [], self.r.randint(40, 90)
            for w in words:
                if lines and len(lines[-1]) + len(w) < wide:
                    lines[-1] += " " + w
                else:
                    lines.append(w)
            text = ("\n" + " " * self.r.choice([0, 0, 2, 4, 6])).join(lines)
            return text.upper() if self.r.random() < 0.15 else text
        form = self.r.choice([0, 1, 2, 3, 4, 5, 6, 7, 6, 7, 8, 9, 10])
        if form <= 3:
            return glue.join(some)
        if form == 10 and lang not in UNSPACED:
            words, lines = " ".join(some[:12]).split(" "), []
            while words:
                n = self.r.randint(4, 8)
                line, words = " ".join(words[:n]), words[n:]
                lines.append(line[:1].upper() + line[1:] + self.r.choice(["", "", ",", ";"]))
            return "\n".join(lines)
        if form == 4:
            return "\n".join(f"{self.r.choice(['A', 'Q', 'rep', 'guest', 'host'])}{self.r.choice([':', '>'])} {glue.join(self.sentence(lang) for _ in range(self.r.randint(1, 3)))}" for _ in some)
        if form == 5:
            return "\n".join(f"[{k // 60:02d}:{k % 60:02d}] {self.r.choice(['A', 'Q', 'rep'])}: {self.sentence(lang)}" for k in range(0, 7 * len(some), 7))
        if form in (6, 7):
            tail = ["", "", "", " 🙏", " :)", "!!", " 😅"]
            lines = [self.sentence(lang).lower() for _ in range(self.r.choice([1, 1, 2, 3, 4, 6, 8, 12, 16]))]
            rate, marks = self.r.choice([0.6, 0.8, 0.95, 1.0]), self.r.choice([".。।۔։።", ".。।۔։።!?！？؟"])
            return "\n".join((s.rstrip(marks) if self.r.random() < rate else s) + (self.r.choice(tail) if self.r.random() < 0.4 else "") for s in lines)
        text, out = glue.join(some), []
        if form == 8:
            words = text.split(" ")
            for w in words:
                if out and len(out[-1]) + len(w) < 70:
                    out[-1] += " " + w
                else:
                    out.append(w)
            return "\n".join(out)
        return self.r.choice([text.upper(), f"# {self.item(lang)}\n{text}", f"{'#' * self.r.randint(1, 3)} {self.item(lang)}", f"# {self.item(lang)}", f"{self.r.choice(['Best', 'Regards', 'Thanks'])},\n{self.r.choice(NAMES)}", "Hello,\n" + text + "\nThanks,\n" + self.r.choice(NAMES), "\n".join(some), " ".join(s.lower().rstrip(".。।") for s in some)])

    def list_(self, lang: str) -> str:
        n, form = self.r.choice([2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 40, 80, 160]), self.r.choice([*range(12), 6, 6, 5])
        # Items of a long list often come from a few phrases.
        pool = [self.item(lang) for _ in range(self.r.choice([6, 10, 16, n]))] if n > 6 else []
        items = [self.r.choice(pool) if pool else self.item(lang) for _ in range(n)]
        if self.r.random() < 0.06:
            return "\n".join(self.r.choice([str.capitalize, str.lower])(self.word_of(lang)) for _ in range(self.r.randint(5, 40)))
        if form in (0, 1):
            mark = self.r.choice(["- ", "* ", "• ", "・", "– ", "+ "])
            return "\n".join(mark + i for i in items)
        if form == 2:
            shape = self.r.choice(["{}. ", "{}) ", "({}) ", "{}: "])
            return "\n".join(shape.format(k + 1) + i for k, i in enumerate(items))
        if form == 3:
            return "\n".join(self.r.choice(["[ ] ", "[x] ", "☐ ", "☑ "]) + i for i in items)
        if form == 4:
            return "\n".join(" " * (2 * self.r.randint(0, 2)) + self.r.choice("-*o") + " " + i for i in items)
        if form == 5:
            return "\n".join(items)
        if form == 6:
            return self.r.choice(["; ", ", ", ", "]).join(self.r.choice(pool) if pool else self.item(lang) for _ in range(max(n, 5)))
        if form == 7:
            return "\n".join(f"{k // 4 + 1}.{k % 4 + 1} {i} {'.' * self.r.randint(4, 30)} {3 * k + 2}" for k, i in enumerate(items))
        if form == 8:
            return "\n".join(f"{self.ident()}: {i}" for i in items)
        if form == 9:
            return "\n".join(f"https://{self.r.choice(['docs', 'kb'])}.{self.r.choice(NAMES).lower()}.example/{self.r.choice(['a', 'boats'])}/{self.r.randint(1, 900)}{self.r.choice(['', '.html', '?q=a&d=7'])}" for _ in items)
        if form == 10:
            return self.r.choice([", ", "; "]).join(self.item(lang) for _ in range(self.r.randint(6, 16)))
        mark = self.r.choice(["- ", "* ", "1. "])
        return "\n".join(mark + self.sentence(lang) for _ in range(min(n, 8)))

    def table(self, lang: str) -> str:
        cols, n, form = self.r.randint(3, 7), self.r.choice([2, 3, 4, 5, 6, 8, 10, 12, 16, 30, 60]), self.r.choice([*range(9), 7])
        head = [self.phrase(lang) for _ in range(cols)]
        rows = [head] + [[self.cell(lang) for _ in head] for _ in range(n)]
        if form == 0:
            rule = ["|" + "---|" * cols]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            return "\n".join(lines[:1] + (rule if self.r.random() < 0.8 else []) + lines[1:])
        if form == 1:
            bar = "+" + "----------------+" * cols
            return "\n".join([bar] + [x for r in rows for x in ("|" + "|".join(c[:15].ljust(16) for c in r) + "|", bar)])
        if form == 2:
            return "\n".join("\t".join(r) for r in rows)
        if form == 3:
            quoted, mark = self.r.choice([0, 0.4]), self.r.choice(",;")
            return "\n".join(mark.join(f'"{c}"' if self.r.random() < quoted else c for c in r) for r in rows)
        if form == 4:
            return "\n".join("".join(c[:20].ljust(22) for c in r).rstrip() for r in rows)
        if form == 5:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
        if form == 7:
            indent, rule = self.r.choice(["  ", "", "    "]), self.r.choice(["", "", "\\hline\n", "\\midrule\n"])
            lines = [indent + " & ".join(c.replace("_", r"\_") for c in r) + r" \\" for r in rows]
            body = lines[0] + "\n" + rule + "\n".join(lines[1:])
            return "\\begin{tabular}{" + "l" * cols + "}\n" + body + "\n\\end{tabular}" if self.r.random() < 0.7 else body
        names = [self.phrase(lang) for _ in range(self.r.randint(2, 4))]
        if form == 8:
            return "\n".join(f"{k}: {self.cell(lang)}" for _ in range(self.r.randint(2, 6)) for k in names)
        return "\n".join(f"{k} = {self.cell(lang)}" for _ in range(self.r.randint(1, 6)) for k in names)

    def word(self) -> str:
        return "".join(self.r.choice("qwertzuiopasdfghjklxcvbnm") for _ in range(self.r.randint(1, 12)))

    def expr(self, deep: int = 0) -> str:
        x = self.r.randint(0, 9 if deep < 2 else 4)
        if x <= 1:
            return self.noun()
        if x == 2:
            return str(self.r.randint(0, 900))
        if x == 3:
            return self.ident()
        if x == 4:
            return f'"{self.phrase("en")}"'
        if x == 5:
            return f"{self.noun()}.{self.noun()}"
        if x == 6:
            return f"{self.noun()}[{self.expr(deep + 1)}]"
        if x == 7:
            return f"{self.expr(deep + 1)} {self.r.choice(['+', '-', '*', '/', '==', '<', '>='])} {self.expr(deep + 1)}"
        return f"{self.noun()}({', '.join(self.expr(deep + 1) for _ in range(self.r.randint(0, 3)))})"

    def code(self) -> str:
        """A piece of a program, a style sheet, a configuration, markup or a session."""
        n, form, out = self.r.choice([1, 1, 2, 3, 4, 6, 9]), self.r.choice([*range(17), 14]), []
        remark = lambda mark: [f"{mark} {self.sentence('en')}"] if self.r.random() < 0.3 else []
        if form == 0:
            out += [f"import {self.noun()}", f"from {self.noun()}.{self.noun()} import {self.noun()}, {self.ident()}"][: self.r.randint(0, 2)]
            for _ in range(n):
                out += [f"{'    ' * self.r.randint(0, 1)}def {self.ident()}(self, {self.noun()}, {self.noun()}=None):", *[f"    {r}" for r in remark("#")]]
                out += [f"        {self.r.choice(['return ', self.noun() + ' = ', 'if ', 'for x in ', 'assert ', 'self.' + self.noun() + ' = '])}{self.expr()}{self.r.choice(['', '', ':'])}" for _ in range(self.r.randint(1, 4))]
            if self.r.random() < 0.4:
                out += ["", f"for {self.noun()} in {self.expr()}:", f"    {self.noun()}({self.noun()}, {self.noun()})", f"if {self.noun()} == '{self.noun()}':", f"    {self.expr()}"][self.r.randint(0, 2) :]
                out = [line for line in out if line]
        elif form in (1, 2):
            kind = self.r.choice(["int", "void", "static char *", "public String", "private final int", "func", "fn", "function", "double"])
            for _ in range(n):
                out += [*remark("//"), f"{kind} {self.noun()}({self.r.choice(['int ', 'String ', 'const char *', ''])}{self.noun()}) {{"]
                out += [f"    {self.r.choice(['return ', 'int x = ', self.noun() + ' += ', 'this.' + self.noun() + ' = ', ''])}{self.expr()};" for _ in range(self.r.randint(1, 4))]
                out += [f"    for (int i = 0; i < {self.expr(2)}; i++) {{", f"        {self.noun()}[i] = {self.expr()};", "    }"][: self.r.choice([0, 3])] + ["}"]
        elif form == 3:
            for _ in range(n):
                out += [f"{self.r.choice(['const', 'let', 'var'])} {self.noun()} = {self.r.choice(['', 'await ', 'new '])}{self.expr()};", f"{self.noun()}.{self.noun()}(({self.noun()}) => {{", f"  if ({self.expr()}) {{ return {self.expr()}; }}", "});"]
        elif form == 4:
            for _ in range(n):
                out += [self.r.choice([f"$ cd /opt/{self.noun()} && ls -la", f"grep -r {self.noun()} /var/{self.noun()} | sort -u > /tmp/{self.noun()}.txt", f"export {self.noun().upper()}=${{{self.noun().upper()}:-{self.noun()}}}", f'if [ -f "$HOME/.{self.noun()}" ]; then', f"curl -sS -X POST http://localhost:{self.r.randint(1000, 9000)}/{self.noun()} -d @{self.noun()}.json", f"pip install --upgrade {self.noun()}=={self.r.randint(0, 9)}.{self.r.randint(0, 9)}", f"chmod +x ./{self.noun()}.sh"])]
        elif form == 5:
            for _ in range(n):
                out += [f"{self.r.choice(['.', '#', ''])}{self.noun()}{self.r.choice(['', ':hover', ' > li', '-' + self.noun()])} {{", *[f"  {self.r.choice(STYLES)}: {self.r.choice(['0 auto', f'{self.r.randint(1, 40)}px', f'#{self.r.randbytes(3).hex()}', 'none', 'block'])};" for _ in range(self.r.randint(1, 5))], "}"]
            if self.r.random() < 0.3:
                out = [" ".join(out).replace("  ", " ").replace("} ", "}\n")]
        elif form == 6:
            for _ in range(n):
                out += [self.r.choice([f"\\section{{{self.phrase('en')}}}", f"\\label{{sec:{self.noun()}}}", f"\\begin{{{self.noun()}}}[{self.noun()}]", f"\\end{{{self.noun()}}}", f"$${self.noun()[0]}_{{i}} = \\frac{{{self.r.randint(1, 9)}}}{{x^{{{self.r.randint(2, 4)}}}}} + \\sum_{{k=1}}^n a_k$$", f"\\usepackage[{self.noun()}]{{{self.noun()}}}", f"\\cite{{{self.noun()}{self.r.randint(1990, 2020)}}} \\ref{{eq:{self.noun()}}}", f"\\newcommand{{\\{self.noun()}}}{{\\mathbf{{x}}}}"])]
        elif form == 7:
            for _ in range(n):
                out += [f"{self.noun()}:", *[f"  {self.noun()}: {self.r.choice([str(self.r.randint(0, 900)), 'true', 'false', self.ident(), f'{chr(34)}{self.noun()}{chr(34)}'])}" for _ in range(self.r.randint(1, 4))], *[f"  - {self.ident()}" for _ in range(self.r.choice([0, 0, 2]))]]
        elif form == 8:
            for _ in range(n):
                out += [f"[{self.noun()}.{self.noun()}]", *remark(";"), *[f"{self.noun()}_{self.noun()}{self.r.choice(['=', ' = '])}{self.r.choice([str(self.r.randint(0, 900)), 'on', 'off', '/var/' + self.noun()])}" for _ in range(self.r.randint(1, 4))]]
        elif form == 9:
            out = ['<?xml version="1.0"?>'][: self.r.randint(0, 1)] + [f'<{a} id="{self.r.randint(1, 99)}" class="{self.noun()}"><{b}>{self.r.choice([self.phrase("en"), ""])}</{b}></{a}>' for a, b in ((self.noun(), self.noun()) for _ in range(n))]
        elif form == 10:
            out = [f"--- a/{self.noun()}.c", f"+++ b/{self.noun()}.c", f"@@ -{self.r.randint(1, 90)},{self.r.randint(1, 9)} +{self.r.randint(1, 90)},{self.r.randint(1, 9)} @@"] + [f"{self.r.choice(' +-')}{'  ' * self.r.randint(0, 3)}{self.noun()} = {self.expr()};" for _ in range(n)]
        elif form == 11:
            out = [f"java.lang.{self.noun().title()}Exception: {self.phrase('en')}"] + [f"\tat org.{self.noun()}.{self.noun()}.{self.noun().title()}.{self.noun()}({self.noun().title()}.java:{self.r.randint(1, 900)})" for _ in range(n)]
        elif form == 12:
            out = [f"{self.r.choice(['GET', 'POST', 'HTTP/1.1'])} /{self.noun()}?{self.noun()}={self.r.randint(1, 9)} HTTP/1.1"] + [f"{h}: {self.r.choice(['text/html; charset=utf-8', 'gzip, deflate', self.noun() + '.example', 'no-cache', 'W/' + self.r.randbytes(4).hex(), str(self.r.randint(0, 900))])}" for h in self.r.sample(HEADERS, 6)]
        elif form == 14:
            case = self.r.choice([str.upper, str.lower])
            for _ in range(self.r.choice([1, 1, 2, 4])):
                a, b = self.noun()[0], self.noun()[-1]
                parts = [f"{case('select')} {self.r.choice(['*', f'{a}.{self.noun()}, {b}.{self.noun()}', case('count') + f'(*), {a}.id'])}", f"{case('from')} {self.noun()} {a}"]
                parts += [f"{self.r.choice([case('join'), case('left join')])} {self.noun()} {b} {case('on')} {a}.{self.r.choice(['id', 'uid', self.noun() + '_id'])} = {b}.id" for _ in range(self.r.randint(0, 2))]
                parts += [f"{case('where')} {a}.{self.noun()} {self.r.choice(['>', '=', '<>', case('like')])} {self.r.choice([str(self.r.randint(0, 900)), chr(39) + self.noun() + chr(39)])}"][: self.r.randint(0, 1)]
                parts += [f"{case('group by')} {b}.{self.noun()}", f"{case('order by')} {self.r.randint(1, 4)} {case('desc')}", f"{case('limit')} {self.r.randint(1, 90)}"][self.r.randint(0, 3) :]
                out += [self.r.choice([" ", " ", "\n"]).join(parts) + self.r.choice([";", ""])]
        elif form == 15:
            host = lambda: ".".join(str(self.r.randint(1, 254)) for _ in range(4))
            out = [f'{host()} - - [{self.r.randint(1, 28)}/Oct/{self.r.randint(1995, 2024)}:{self.r.randint(10, 23)}:{self.r.randint(10, 59)}:{self.r.randint(10, 59)} +0000] "{self.r.choice(["GET", "POST"])} /{self.noun()}/{self.noun()} HTTP/1.1" {self.r.choice([200, 404, 301])} {self.r.randint(1, 90000)}' for _ in range(n)]
        elif form == 16:

            def nested(deep: int) -> str:
                one = lambda: self.r.choice([f'"{self.noun()}"', f'"{self.r.choice("^~")}{self.r.randint(0, 9)}.{self.r.randint(0, 9)}"', str(self.r.randint(0, 900)), "true", "null", nested(deep + 1) if deep < 2 else "[]"])
                return "{" + ", ".join(f'"{self.noun()}": {one()}' for _ in range(self.r.randint(1, 5))) + "}"

            out = [nested(0) for _ in range(self.r.choice([1, 1, 1, 3]))]
        else:
            out = [f"Host: {self.noun()}" if self.r.random() < 0.05 else f"{self.noun()}{self.r.choice(['++', '--', ' <- ', ' := ', ' => ', ' |> '])}{self.expr()}{self.r.choice([';', '', ' end', ' |'])}" for _ in range(n + 2)]
        return "\n".join(out)

    def junk(self, lang: str) -> str:
        n, form = self.r.randint(3, 20), self.r.choice([*range(17), 14, 14, 3, *[11] * 6, 12, 8, 9, *[16] * 24])
        if form == 16:
            return self.code()
        if form == 0:
            raw = base64.b64encode(self.r.randbytes(40 * n)).decode()
            return "\n".join(raw[k : k + 76] for k in range(0, len(raw), 76)) if self.r.random() < 0.7 else raw
        if form == 1:
            return "\n".join(f"{16 * k:08x}  " + " ".join(f"{self.r.randrange(256):02x}" for _ in range(16)) for k in range(n))
        if form == 2:
            return "".join(f'<div class="{self.noun()}-{self.r.randint(1, 99)}"><span id="{self.ident()}"></span></div>' for _ in range(n))
        if form == 3:
            between = self.r.choice([",", ",", ",\n", "\n"])
            return "[" + between.join("{" + f'"{self.noun()}":"{self.r.randint(1, 900)}","{self.r.choice(["v2", "all", "raw"])}":"{self.r.uniform(0, 40):.1f}","id":"{self.ident()}"' + "}" for _ in range(n)) + "]"
        if form == 4:
            return f"with base as (select {self.ident()}.id, count(*) as n_{self.noun()} from core.{self.noun()}\n" + "\n".join(f"  left join {self.r.choice(['raw', 'core', 'old'])}.{self.noun()} t{k} on t{k}.{self.noun()}_id = base.id and t{k}.day >= {self.r.randint(1, 900)}" for k in range(self.r.randint(1, 60))) + "\n  group by 1)\nselect * from base"
        if form == 5:
            return "Traceback:\n" + "\n".join(f'  File "/opt/app/{self.ident()}.sql", line {self.r.randint(1, 900)}, in {self.ident()}\n    {self.noun()}[{self.r.randint(1, 900)}] = {self.ident()}({self.r.randint(1, 900)})' for _ in range(n))
        if form == 6:
            return "\n".join(f"2024-{self.r.randint(1, 12):02d}-{self.r.randint(1, 28):02d}T{self.r.randint(0, 23)}:{self.r.randint(10, 59)}:07Z {self.r.choice(['DEBUG', 'INFO', 'WARN', 'ERROR'])} [{self.ident()}] rc={self.r.randint(0, 900)} t={self.r.uniform(0, 40):.1f}ms req={self.r.randbytes(5).hex()}" for _ in range(n))
        if form == 7:
            return "\n".join(" ".join(f"{self.r.uniform(0, 9):.3f}" for _ in range(self.r.choice([5, 6]))) for _ in range(n))
        if form == 8:
            return " ".join(self.word() for _ in range(8 * n))
        if form == 9:
            return " ".join(" ".join(self.word() for _ in range(self.r.randint(4, 12))).capitalize() + "." for _ in range(n))
        if form == 10:
            return "\n".join(self.r.choice("~*$&_%=-@#") * self.r.randint(14, 50) for _ in range(n))
        if form == 11:
            if self.r.random() < 0.4:
                return self.r.choice([" ", "\n"]).join(self.r.choice([str.upper, str])(self.r.choice(SHOUTS)) + self.r.choice(["!", "!!", "!!!", "!!! $$$", " >>> "]) for _ in range(self.r.randint(3, 40)))
            return self.r.choice([" · ", " | ", "\n", " > "]).join(self.r.choice(MENU) for _ in range(self.r.randint(8, 90)))
        text = " ".join(self.sentence(lang) for _ in range(n))
        if form == 12:
            other = " ".join(self.sentence(self.r.choice(["zh", "hi", "ar", "ja", "hy", "am", "fr"])) for _ in range(n))
            return other.encode().decode("latin-1").replace("\x85", " ")
        if form == 13:
            rate = self.r.uniform(0.2, 0.45)
            return "".join(self.r.choice("¦§¤�#~^|") if c != "\n" and self.r.random() < rate else c for c in text)
        if form == 15:
            return f"```\nselect * from {self.ident()}\nwhere day > {self.r.randint(1, 9)}\n```"
        one = self.sentence(lang)
        return self.r.choice(["", " ", "\n"]).join(one.rstrip(".") if self.r.random() < 0.5 else one + f" ({self.r.randint(1, 200)})" for _ in range(2 * n)) if self.r.random() < 0.5 else self.r.choice([" ", "\n"]).join([one + (f" ({k})" if k % 3 else "") for k in range(2 * n)])


def labelled(count: int, seed: int) -> list[tuple[str, str]]:
    """(label, block): ``count`` blocks, half of them prose."""
    make = Maker(seed)
    kinds = [("prose", make.prose), ("prose", make.prose), ("prose", make.prose), ("list", make.list_), ("table", make.table), ("junk", make.junk)]
    out = []
    for k in range(count):
        label, f = kinds[k % len(kinds)]
        lang = "th" if make.r.random() < 0.05 else "en" if make.r.random() < 0.25 else make.r.choice(LANGS)
        out.append((label, f(lang)))
    return out
