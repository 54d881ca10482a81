"""Pattern packs for Russian prose: what each category looks for, and what a hit costs."""

# Results depend on exactly these patterns, words and points.

HARD = (
    r"в современном мире",
    r"на сегодняшний день",
    r"в настоящее время",
    r"в наше время",
    r"в наши дни",
    r"стоит отметить",
    r"следует отметить",
    r"важно отметить",
    r"нельзя не отметить",
    r"важно понимать",
    r"важно помнить",
    r"необходимо подчеркнуть",
    r"хочется отметить",
    r"хотелось бы отметить",
    r"не секрет,? что",
    r"ни для кого не секрет",
    r"как известно",
    r"всем известно",
    r"давайте разбер[её]мся",
    r"давайте рассмотрим",
    r"давайте посмотрим",
    r"подводя итог",
    r"в заключение",
    r"резюмируя",
    r"^таким образом,",
    r"^итак,",
    r"надеюсь,? (это )?помо",
    r"если (у вас )?(возникнут|будут|появятся) вопросы",
    r"буду рад помочь",
    r"обращайтесь",
    r"спасибо за внимание",
    r"с уважением",
    r"отличный вопрос",
    r"хороший вопрос",
    r"мощн(ый|ым) инструмент",
    r"открывает новые (горизонты|возможности)",
    r"играет (ключевую|важную) роль",
    r"ключевую роль",
    r"имеет (важное|большое) значение",
    r"оказывает (существенное |значительное )?влияние",
    r"в рамках",
    r"в целях",
    r"в части",
    r"в контексте",
    r"в разрезе",
    r"имеет место",
    r"имеет место быть",
    r"на (ежедневной|постоянной|регулярной) основе",
    r"в конечном (итоге|сч[её]те)",
    r"^как правило,",
    r"широкий спектр",
    r"целый ряд",
    r"ряд преимуществ",
    r"в конце дня",
    r"делает смысл",
    r"хорош(ие|ая) новост",
    r"плох(ие|ая) новост",
    r"как (ты|вы) и (просил|просили|хотел|хотели)",
    r"небольшой апдейт",
    r"хотел (бы )?(рассказать|поделиться|сообщить)",
    r"данн(ый|ая|ое|ому|ой|ом|ую|ыми)\b",
)

PARALLEL = (
    r"не просто \S+(\s\S+){0,4},? а ",
    r"это не \S+(\s\S+){0,4}[,—–-] (а|это) ",
    r"дело не в \S+(\s\S+){0,3},? а в ",
)

CALQUE = (
    r"\bявля(ется|ются|лся|лась|лось|лись|ться)\b",
    r"представля(ет|ют) собой",
    r"носит (\w+ )?характер",
    r"(имеет|дает|да[её]т|предоставляет|предоставит) возможность",
    r"\bпозволя(ет|ют)\b",
    r"\bобеспечива(ет|ют)\b",
    r"\bосуществля(ет|ют|ть|ется|ются)\b",
    r"\bпроизвод(ит|ят|ится|ятся)\b",
    r"\bфункционал\b",
    r"опыт пользователя",
    r"проактивно",
    r"\bкоммуницир",
    r"\bменеджерить",
    r"на (моей|вашей|твоей|нашей|их) стороне",
    r"\bэто про\b",
    r"\bфокусир",
)

INTRO = (
    r"безусловно",
    r"бесспорно",
    r"без сомнения",
    r"\bконечно\b",
    r"разумеется",
    r"\bочевидно\b",
    r"естественно",
    r"несомненно",
    r"к сожалению",
    r"к счастью",
    r"честно говоря",
    r"если честно",
    r"по правде говоря",
    r"признаться",
    r"на мой взгляд",
    r"по моему мнению",
    r"как мне кажется",
    r"мне кажется",
    r"\bкстати\b",
    r"между прочим",
    r"\bвпрочем\b",
    r"вообще говоря",
    r"\bсобственно\b",
    r"по сути",
    r"в принципе",
    r"в общем",
    r"в общем-то",
    r"во-первых",
    r"во-вторых",
    r"в-третьих",
    r"\bнаконец\b",
    r"\bдалее\b",
    r"\bдопустим\b",
    r"\bскажем\b",
    r"другими словами",
    r"иными словами",
    r"\bточнее\b",
    r"\bвернее\b",
    r"более того",
    r"кроме того",
    r"помимо (этого|того)",
    r"при этом",
    r"^также\b",
    r"тем не менее",
    r"в свою очередь",
    r"в частности",
    r"действительно",
    r"на самом деле",
    r"фактически",
    r"практически",
    r"буквально",
    r"\bдовольно\b",
    r"\bвесьма\b",
    r"\bкрайне\b",
    r"абсолютно",
    r"совершенно",
    r"\bочень\b",
    r"в целом",
    r"в итоге",
    r"по большому сч[её]ту",
    r"так или иначе",
    r"в любом случае",
)

EVAL = (
    r"эффективн",
    r"качественн",
    r"уникальн",
    r"над[её]жн",
    r"оптимальн",
    r"современн",
    r"инновационн",
    r"удобн",
    r"\bважн",
    r"актуальн",
    r"значительн",
    r"существенн",
    r"серь[её]зн",
    r"огромн",
    r"\bмощн",
    r"отличн",
    r"прекрасн",
    r"замечательн",
    r"\bлучш",
    r"идеальн",
    r"превосходн",
    r"великолепн",
    r"комфортн",
    r"выгодн",
    r"профессиональн",
    r"компетентн",
    r"успешн",
    r"продвинут",
    r"передов",
    r"интересн",
    r"полезн",
    r"\bценн",
    r"максимальн",
    r"глубок(ий|ая|ое|о) (анализ|понимание|проработк)",
    r"тщательн",
    r"детальн",
    r"всесторонн",
    r"комплексн",
    r"системн(ый|ая|ое|о) подход",
    r"грамотн",
    r"ч[её]тк",
    r"прозрачн",
    r"стабильн",
    r"устойчив",
    r"проверенн",
    r"гарантированн",
    r"кардинальн",
    r"оперативн",
    r"своевременн",
    r"корректн",
    r"высок(ое|ий|ого|им) (качеств|уровен|уровн)",
    r"по-настоящему",
    r"настоящ(ий|ая|ее) ",
    r"по праву",
    r"заслуженно",
)

BUREAU = (
    r"осуществлени",
    r"обеспечени",
    r"реализаци",
    r"внедрени",
    r"функционировани",
    r"взаимодействи",
    r"проведени",
    r"выполнени",
    r"направлени",
    r"мероприяти",
    r"использовани",
    r"осуществить",
    r"произвести",
    r"обеспечить",
    r"в связи с",
    r"с целью",
    r"по причине",
    r"по вопросу",
    r"в отношении",
    r"в области",
    r"в сфере",
    r"в процессе",
    r"при помощи",
    r"посредством",
    r"\bпут[её]м\b",
    r"в случае,? если",
    r"в ходе",
    r"по итогам",
    r"на предмет",
    r"в соответствии с",
    r"в установленном порядке",
    r"надлежащ",
    r"соответствующ(ий|ие|ая|ее|им|их|его|ей)\b",
    r"\bнеобходимо\b",
    r"\bтребуется\b",
    r"\bследует\b",
    r"оказать содействие",
    r"принять меры",
    r"(проводить|вести|провести) работу",
    r"в настоящий момент",
    r"на (данный|текущий) момент",
    r"вышеуказанн",
    r"нижеследующ",
    r"вышеупомянут",
    r"уведомля(ю|ем)",
    r"довожу до сведения",
    r"доводим до (вашего )?сведения",
    r"прошу (вас )?(рассмотреть|обратить внимание)",
    r"(производится|осуществляется|выполняется|проводится|планируется|предполагается|рассматривается|используется|обеспечивается)\b",
)

VAGUE = (
    r"\b(более|свыше|около|порядка|почти|не менее|не более) \d",
    r"\bнекотор(ые|ых|ым|ой|ая|ое)\b",
    r"в ряде случаев",
    r"\bразличн",
    r"\bмногие\b",
    r"\bмножество\b",
    r"\bмасса\b",
    r"\bзачастую\b",
    r"\bнередко\b",
    r"периодически",
    r"в основном",
    r"в большинстве случаев",
    r"определ[её]нн(ые|ых|ый|ая|ое|ую)\b",
    r"те или иные",
    r"тот или иной",
    r"и т\.\s?д\.",
    r"и т\.\s?п\.",
    r"и други(е|х)\b",
    r"и прочее",
    r"и так далее",
    r"как(ой|ие|ая|ое)-то\b",
    r"\bнек(ий|ая|ое)\b",
    r"\bчто-то\b",
    r"\bкто-то\b",
    r"\bот \d[\d\s]*\s?(₽|руб|\$|€|֏|тыс)",
    r"\bсколько-то\b",
    r"\bнесколько\b",
)

PACKS = {
    "hard": HARD,
    "parallel": PARALLEL,
    "calque": CALQUE,
    "intro": INTRO,
    "eval": EVAL,
    "bureau": BUREAU,
    "vague": VAGUE,
}

TRANSITION = r"^(также|кроме того|помимо этого|при этом|таким образом|в целом|в итоге|более того|важно|стоит|следует|отметим|заметим|напомним|в заключение|подводя)\b"
GREETING = r"^(привет|здравствуйте|добрый день|доброе утро|добрый вечер|хай|йо|hi|hello)\b"

COMMON_ADJECTIVES = (
    "длинный",
    "странный",
    "ценный",
    "сонный",
    "данный",
    "временный",
    "современный",
    "постоянный",
    "обыкновенный",
    "сторонний",
    "старинный",
    "подлинный",
    "истинный",
    "бесценный",
    "единственный",
    "многочисленный",
    "мгновенный",
    "весенний",
    "осенний",
    "зимний",
    "летний",
    "утренний",
    "вечерний",
    "ранний",
    "поздний",
    "внутренний",
    "внешний",
    "средний",
    "нижний",
    "верхний",
    "последний",
    "прежний",
    "нынешний",
    "домашний",
    "соседний",
    "лишний",
    "ближний",
    "дальний",
    "крайний",
    "дневной",
    "ночной",
)

PENALTY = {
    "hard": 8,
    "parallel": 3,
    "calque": 4,
    "intro": 2,
    "eval": 2,
    "bureau": 3,
    "vague": 2,
    "passive": 2,
    "participle": 1,
    "transition": 2,
    "long_sentence": 2,
    "dash_excess": 1,
    "triad_excess": 1,
    "bold_excess": 1,
    "emoji_excess": 1,
    "header_in_short": 2,
    "paren_excess": 1,
    "not_only": 2,
    "greeting": 3,
    "foreign_number": 6,
    "english_prose": 3,
}

#: Patterns of the rules besides the packs, over the normal form.
PASSIVE = r"\b(был|была|было|были)\s+([а-я]+(?:н|на|но|ны|т|та|то|ты))\b"
PARTICIPLE = r"\b[а-я]{3,}(?:ующ|ющ|ащ|ящ|вш|енн|анн|янн)(?:ий|ая|ое|ые|его|ей|им|их|ими|ем|ую|ым|ых|ой|ому|ом)\b"
PARTICIPLE_END = r"(ий|ая|ое|ые|его|ей|им|их|ими|ем|ую|ым|ых|ой|ому|ом)$"
TRIAD = r"[а-яё«»\"\w-]+, [а-яё«»\"\w-]+ и [а-яё«»\"\w-]+"
NOT_ONLY = r"не только .{2,60}?, но и"
EMOJI = r"[\x{1F300}-\x{1FAFF}☀-➿]"
NUMBER = r"[0-9][0-9 \x{A0}.,]*[0-9]|[0-9]"
WORD = r"[а-яa-z0-9]+(?:[-.,][а-яa-z0-9]+)*"

#: Limits of the rules: words of a sentence, dashes in a hundred words, share of Latin words, and the like.
LONG_SENTENCE, DASH_RATE, LATIN_SHARE = 25, 4, 0.15
MOST_BOLD, BOLD_UNDER, MOST_EMOJI, HEADER_UNDER, TRIAD_WORDS, PAREN_WORDS, SHOWN = 3, 400, 3, 200, 150, 100, 12

#: Common HTML entities in the order in which they are replaced.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&"))

#: Names of one category in several catalogues.
CATEGORY_ALIASES = {
    "stories": ("story",),
    "story": ("story",),
    "education": ("explainer",),
    "explainer": ("explainer",),
    "art3d": ("3d", "art"),
    "3d": ("3d",),
    "art": ("art",),
    "motion": ("motion",),
    "product": ("product",),
    "production": ("production",),
    "game": ("game",),
    "interactive": ("interactive",),
    "comparison": ("comparison",),
}

#: Rank of the qualities of a prompt, formats of an orientation, least views of a ratio sort, days a cache is fresh.
QUALITY_RANK = {"full": 3, "brief": 2, "partial": 1}
ORIENTATIONS = {"vertical": ("9:16", "4:5"), "portrait": ("9:16", "4:5"), "horizontal": ("16:9", "4:3"), "landscape": ("16:9", "4:3"), "square": ("1:1",)}
RATIO_FLOOR, FRESH_DAYS, PAGE_DAYS = 5000, 14, 7

#: Weights of the wait before a key, by the character before it and the character itself.
TYPING = {"first": 1.4, "line": 4.0, "stop": 3.2, "comma": 2.2, "space": 1.6, "capital": 1.35, "before_space": 0.85}

#: Captions and voice: characters of a caption, pauses in seconds, edges, and what inner pauses become.
CAPTION = {"most": 42, "hard_gap": 0.4, "soft_gap": 0.25, "lead": 0.05, "tail": 0.15, "least": 0.7, "join": 0.3, "fast": 17.0}
VOICE = {"gap": 0.28, "breath": 0.45, "sentence": 0.6, "tail": 0.05, "unheard": 0.3, "windows": (0.45, 0.3), "shortest": 0.04}
