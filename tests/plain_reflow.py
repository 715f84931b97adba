"""Paragraph reflow in plain Python, character by character: written from the rules' description, it shares nothing with the library."""

WS = {chr(x) for x in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]}
PAIRS = dict(zip("（([［{｛<＜〈【《〔〖", "）)]］}｝>＞〉】》〕〗", strict=True))
OPEN_TALK, CLOSE_TALK = "“‘「『﹁﹃", "”’」』﹂﹄"
QUOTES = [("“", "”"), ("‘", "’"), ("「", "」"), ("『", "』"), ("﹁", "﹂"), ("﹃", "﹄")]
STRONG, COMMAS, COLONS = "。！？!?", "，,、", "：:"
CLAUSE = "。！？；：…—”」’』）】》〗〕］｝＞〉>.):!?"
NUMERALS = "0123456789０１２３４５６７８９一二三四五六七八九十"
KEYS = "書名 书名 作者 原著 譯者 译者 校訂 校订 產品經理 产品经理 出版社 出版時間 出版时间 出版日期 版權 版权 版權頁 版权页 版權信息 版权信息 責任編輯 责任编辑 編輯 编辑 責編 责编 定價 定价 簡介 简介 前言 序章 終章 终章 尾聲 尾声 後記 后记 品牌方 出品方 授權方 授权方 電子版權 数字版权 掃描 扫描 發行 发行 OCR CIP 在版編目 在版编目 分類號 分类号 主題詞 主题词 類型 类型 標簽 标签 内容標簽 内容标签 系列 發行日 发行日 初版 ISBN".split()


def han(c):
    return "㐀" <= c <= "䶿" or "一" <= c <= "鿿" or "豈" <= c <= "﫿"


def letter(c):
    return c.isascii() and c.isalpha()


def digit(c):
    return c in "0123456789０１２３４５６７８９"


def units(s):
    return sum(1 + (ord(c) > 0xFFFF) for c in s)


def visible(s):
    return [c for c in s if c not in WS]


def trim(s):
    a, b = 0, len(s)
    while a < b and s[a] in WS:
        a += 1
    while b > a and s[b - 1] in WS:
        b -= 1
    return s[a:b]


def mostly_han(s):
    h = a = 0
    for c in s:
        h += han(c)
        a += letter(c)
        if a > h + 4:
            return False
    return h > 0 and h >= a


def mixed(s):
    h = a = False
    for c in s:
        if han(c):
            h = True
        elif letter(c) or digit(c):
            a = True
        elif c not in " -/:.—–…·・～―‐、：":
            return False
        if h and a:
            return True
    return False


def bracket_trouble(s):
    due = []
    for c in s:
        if c in PAIRS:
            due.append(PAIRS[c])
        elif c in PAIRS.values() and (not due or due.pop() != c):
            return True
    return bool(due)


def quote_trouble(s):
    for a, b in QUOTES:
        n = 0
        for c in s:
            n += (c == a) - (c == b or a == "“" and c in "〞〟")
            if n < 0:
                return True
        if n:
            return True
    return False


def latin(text):
    head = visible(text)[:200]
    good = sum(c.isascii() and (c.isalnum() or c in ".,!?:;'\"()[]{}-_/\\@#$%&*+=<>") or "À" <= c <= "ɏ" or "Ḁ" <= c <= "ỿ" for c in head)
    return not any(map(han, head)) and len(head) >= 40 and good * 10 >= len(head) * 9


def divider(s):
    v = visible(s)
    return len(v) >= 3 and all("─" <= c <= "╿" or c in "-=_~～*＊★☆" for c in v)


def once(words):
    for i in range(len(words)):
        for n in range(1, 9):
            copies = 1
            while words[i + copies * n : i + (copies + 1) * n] == words[i : i + n] and len(words[i : i + n]) == n:
                copies += 1
            if copies >= 3:
                return words[: i + n] + words[i + copies * n :]
    return words


def unit(word):
    if 4 <= len(word) <= 100:
        for n in range(4, 11):
            if len(word) % n == 0 and len(word) >= 3 * n and word == word[:n] * (len(word) // n):
                return word[:n]
    return word


def collapsed(s):
    words = [w for w in s.replace("\t", " ").split(" ") if w]
    return " ".join(unit(w) for w in once(words)) if words else s


def title(s):
    line = s.split("\n")[0]
    if len(s) > 50 or any(c in ",，" for c in line[20:]):
        return False
    if s.startswith(("目录", "目錄", "前言", "序章", "楔子", "终章", "尾声", "尾聲", "后记", "後記", "番外")):
        return True
    for i, c in enumerate(s[:11]):
        if c == "第":
            for j in range(i + 1, min(len(s) - 1, i + 7)):
                if s[j] in "章节部卷節回" and s[j + 1] not in "分合的":
                    return True
    return len(s) >= 2 and s[0] in "卷章" and s[1] in "一二三四五六七八九十"


def metadata(s):
    if units(s) > 30:
        return False
    at = next((i for i, c in enumerate(s) if c in ":：　·・" and visible(s[:i])), -1)
    lead = len(s) - len(s.lstrip("".join(WS)))
    first = next((i for i, c in enumerate(s) if i >= lead and c in ":：　·・"), -1)
    if at < 0 or first != at:
        return False
    key, value = s[lead:at], visible(s[at + 1 :])
    return 0 < len(key) <= 4 and trim(key) in KEYS and bool(value) and value[0] not in OPEN_TALK


def heading(s, most, ascii_=True, han_=True, digits=True, mix=True):
    s = trim(s)
    if not s or s.startswith("=== ") and s.endswith("===") or bracket_trouble(s) or quote_trouble(s):
        return False
    last = s[-1]
    if last in COLONS and units(s) <= most and len(s) > 1 and all(map(han, s[:-1])):
        return True
    if last in "）)" and not any(c in COMMAS for c in s):
        return True
    if len(s) >= 3 and PAIRS.get(s[0]) == last and mostly_han(s):
        return True
    if last in CLAUSE or any(c in COMMAS for c in s):
        return False
    low = min(30, max(3, most))
    limit = min(30, max(10, 2 * low)) if ascii_ and s.isascii() or mix and mixed(s) else low
    if units(s) > limit or any(c in STRONG for c in s):
        return False
    number = any(map(digit, s)) and all(digit(c) or c == " " for c in s)
    return bool(ascii_ and s.isascii() or han_ and all(map(han, s)) or digits and number or mix and mixed(s))


def list_item(s):
    s = s.lstrip("".join(WS))
    if s[:1] in set("-*＊•‧▪◦○●※") and s[1:2] in WS:
        return True
    for a, b in ("()", "（）"):
        if s[:1] == a:
            n = s.find(b, 1)
            return n in (2, 3) and all(c in NUMERALS for c in s[1:n])
    for n in (1, 2):
        if len(s) > n and all(c in NUMERALS for c in s[:n]):
            if s[n] in ")）、" or s[n] == "." and (s[n + 1 : n + 2] == " " or s[n + 1 : n + 2] and han(s[n + 1])):
                return True
    return False


def list_bracket_trouble(s):
    t = s.lstrip("".join(WS))
    for n in (2, 1):
        if len(t) > n and all(c in NUMERALS for c in t[:n]) and t[n] in ")）":
            return bracket_trouble(t[n + 1 :])
    return bracket_trouble(s)


def sentence_ends(s, level):
    v = visible(s)
    if not v:
        return False
    body = s.rstrip("".join(WS))
    last, before = v[-1], v[-2] if len(v) > 1 else ""
    if last in STRONG or level >= 3 and last in ".:" and len(body) > 1 and han(body[-2]) and mostly_han(s):
        return True
    if last in CLOSE_TALK + "）)" and before:
        if before in STRONG or before == "." and len(v) > 2 and han(v[-3]) and mostly_han(s):
            return True
    if level >= 3:
        return False
    if mostly_han(s) and (last == "：" or last == "…" or body.endswith("...")):
        return True
    return level < 2 and last in "；：;:"


def bracketed(s):
    s = trim(s)
    if len(s) < 2 or PAIRS.get(s[0]) != s[-1] or not mostly_han(trim(s[1:-1])):
        return False
    depth = 0
    for c in s:
        depth += (c == s[0]) - (c == s[-1])
        if depth < 0:
            return False
    return depth == 0


def reflow(text, compact=False, level=2, most=8, header=False):
    """(segments, joined text); segments None where the text is not touched."""
    if not visible(text or ""):
        return [], ""
    if latin(text):
        return [], text
    out, buf, depth = [], "", [0] * 6

    def flush(reset=True):
        nonlocal buf, depth
        if buf:
            out.append(buf)
            buf = ""
            if reset:
                depth = [0] * 6

    def talk(s):
        for c in s:
            for k, (a, b) in enumerate(QUOTES):
                depth[k] = depth[k] + 1 if c == a else max(0, depth[k] - 1) if c == b else depth[k]

    for raw in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        s = raw.rstrip("".join(WS)).lstrip(" ")
        if divider(s.lstrip(" 　")):
            flush()
            out.append(s)
            continue
        s = collapsed(s)
        probe = s.lstrip(" 　")
        v, held = visible(s), visible(buf)
        last, tail = v[-1] if v else "", held[-1] if held else ""
        if s == "":
            if header or not buf or not (any(depth) or bracket_trouble(buf) or held and tail not in STRONG):
                flush()
            continue
        if s.startswith("=== ") and s.endswith("===") or title(probe) or metadata(probe):
            flush()
            out.append(s)
            continue
        if heading(probe, most):
            goes_on = bool(v) and all(map(han, v)) or last in COLONS or last in "）)"
            if not buf or not bracket_trouble(buf) and (not held or tail not in COMMAS and not (goes_on and tail not in CLAUSE)):
                flush()
                out.append(s)
                continue
        talks, item, closes = v[:1] != [] and v[0] in OPEN_TALK, list_item(s), last != "" and last in CLOSE_TALK
        odd_bracket = list_bracket_trouble(s) if item else bracket_trouble(s)
        odd_quote = quote_trouble(s)
        body = s.rstrip("".join(WS))
        whole = last != "" and last in STRONG + COLONS + "…" or body.endswith("..")
        if talks or item:
            if talks and closes and not odd_bracket and not odd_quote:
                flush(False)
                out.append(s)
                depth = [0] * 6
            elif item and whole and not odd_bracket and not odd_quote:
                flush(False)
                out.append(s)
            else:
                if buf and (item and list_item(buf) or held and tail not in COMMAS and not han(tail) and not any(depth) and not bracket_trouble(buf)):
                    flush(False)
                buf += s
                if talks:
                    depth = [0] * 6
                talk(s)
            continue
        if whole and not any(depth) and not closes and not odd_quote:
            if buf and (units(buf) > 120 or not bracket_trouble(buf)):
                buf += s
                flush()
                continue
            if not buf and not odd_bracket:
                out.append(s)
                continue
        if not buf:
            buf, depth = s, [0] * 6
            talk(s)
        elif closes:
            before = v[-2] if len(v) > 1 else tail
            trouble = bracket_trouble(buf)
            buf += s
            talk(s)
            if not any(depth) and before and before in CLAUSE and (not trouble or odd_bracket or units(buf) > 120):
                flush()
        else:
            lead = next((i for i, c in enumerate(raw) if c not in WS), len(raw))
            if not any(depth) and (sentence_ends(buf, level) and not bracket_trouble(buf) or bracketed(buf) or lead >= 2):
                flush(False)
                buf, depth = s, [0] * 6
            else:
                buf += s
                talk(s)
                continue
            talk(s)
    flush()
    return out, ("\n" if compact else "\n\n").join(out)
