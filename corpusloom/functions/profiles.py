"""Language pairs: everything that depends on which two languages are mixed."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Neighbour:
    """A language that resembles the pair and is routed aside."""

    code: str
    markers: tuple[str, ...]
    letters: str = ""
    patterns: tuple[str, ...] = ()
    letter_weight: int = 3


@dataclass(frozen=True)
class LanguagePair:
    """Languages ``a`` and ``b`` with their letters, function words and shared words."""

    a: str
    b: str
    main_class: str  # letters of the script that the corpus is kept for
    other_class: str  # letters of the script that is held aside
    script_names: tuple[str, str]
    letters_a: str
    letters_b: str
    func_a: tuple[str, ...]
    func_b: tuple[str, ...]
    stop_both: tuple[str, ...]
    shared_seed: tuple[str, ...]
    screen_a: tuple[str, ...]
    screen_b: tuple[str, ...]
    screen_shared: tuple[str, ...]
    accents: tuple[str, str] = ("", "")  # letters, and what they are typed as without accents
    neighbours: tuple[Neighbour, ...] = ()
    evidence_letters: str = ""  # letters that no neighbour has
    promo: tuple[str, ...] = ()

    @property
    def token_class(self) -> str:
        return self.main_class + self.other_class

    @property
    def token(self) -> str:
        """The pattern of a word."""
        return f"[{self.token_class}]+"

    @property
    def screen_ambiguous(self) -> tuple[str, ...]:
        """Words of both screen lists: they vote for neither language."""
        return tuple(sorted(set(self.screen_a) & set(self.screen_b)))

    @property
    def screen_neutral(self) -> tuple[str, ...]:
        return tuple(sorted(set(self.screen_shared) | set(self.screen_ambiguous)))


def _words(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(text.split()))


# Word lists and letters that decide the results of the Kazakh-Russian rules.
KK_LETTERS = "әғқңөұүһі"
RU_LETTERS = "щъё"
RU_FUNCTION = _words("""
и в не на я он с что по это она этот к но они мы как из у который за свой весь от так для ты же все всё тот вы такой его
только или ещё еще бы себя один уже до когда вот кто нет очень если нас них меня тебя нам вам им её ее их сразу конечно просто тоже
также потом теперь почему можно нужно надо где куда зачем сколько какой чтобы потому хотя ведь
был была было были есть будет быть мне тебе
""")
KK_FUNCTION = _words("""
бул осы сол жане бирак ушин сиякты деп гой жок коп жаксы жаман керемет оте енди болды
болган екен еди емес керек калай кайда неге рахмет ракмет салем бар мен сен биз олар кыз
""")
STOP_BOTH = _words("да де та те ал о не а и бар мен")
SHARED_SEED = _words("""
интернет видео видос видио телефон телевизор компьютер лайк репост подписка канал стрим контент блог влог
комментарий коммент топ супер окей ок пж плиз ютуб ютюб тикток инстаграм фейсбук телеграм вайб
подкаст интервью эфир выпуск сезон серия клип музыка фото камера микрофон монтаж студия продюсер
менеджер бизнес маркетинг проект старт финал гость школа класс университет институт доктор автобус такси
банк кредит телеграмм мем хайп кринж респект
""")
SCREEN_KK = _words("""
мен сен ол біз сіз олар бұл осы сол бул осынау және жане бірақ бирак үшін ушин сияқты сиякты деп
ғой гой го ма ме ба бе па пе қой кой бар жоқ жок көп коп аз жақсы жаксы жаман керемет
тым өте оте тағы тагы әлі али енді енди әрине болды болған болган екен еді еди емес керек
қалай калай қайда кайда неге кім ким не қашан рахмет рақмет ракмет сәлем салем ассалаумағалейкум
аға ага әпке апке апа ата тәте тате бауырым сынып оқимын окимын көрдім кордим айтты деген дейді
да де та те ал о
""")
SCREEN_RU = _words("""
и в не на я быть он с что а по это она этот к но они мы как из у который то за свой
весь год от так о для ты же все всё тот мочь вы человек такой его сказать только или ещё еще бы
себя один уже до когда вот кто да нет очень если нас них меня тебя нам вам им её ее их
сразу конечно просто тоже также потом теперь почему давай давайте можно нужно надо хорошо плохо круто
спасибо пожалуйста привет пока лучше больше меньше два три четыре пять сто двести тысяча первый второй
где куда зачем сколько какой чтобы потому хотя ведь
""")
SCREEN_SHARED = _words("""
интернет видео видос видио телефон телевизор компьютер лайк лайкь репост подписка канал стрим контент блог
комментарий коммент топ супер окей ок пж плиз майнкрафт роблокс гта ютуб ютубер тикток инстаграм
мама папа школа класс серия фото клип музыка
""")
KY_MARKERS = _words("""
болот келет кетет көрөт жүрөт айтат берет алат дейт турат жатат кылат кылган кылып кылуу болуу
эле беле эч жана менен экөө силер эмне ошол ушул тигил бирөө бирөөсү окшойт ойлобойсузбу болчу
бактылуу болгула жакшылык кыргыз кыргызмын кыргызстан сүйлөбөдү жебегиле белениз жөнөкөй бөбөктү карытбайт
гүлдөй аласыңбы кылууда кетбейт жолдошунуздун коромин бүтүпсүнөр бутупсунор эчтеке эчнерсе албайм тилинерди
укугун тепселебеген гулдой озунузду ойлобойсуз
""")
UZ_MARKERS = _words("""
ҳамма хаммамизга гунох гунохларимизни аллохим астагфируллох аллох аллохга козок боурлар
мусулмон мусилмонмисан исломни исломми зертла жавоби чиройли утказип домла тогамни дининг гунохлар
""")
UK_MARKERS = _words("""
дякую щиро зустріч приємна пізнавальна маєш можливості знайти необхідне оточення дійти найприємніше
найкорисніше використання висновок розуму щастя немає нещастя захваті казахського передивилася знайшла
виступи черзі чарівні розвитку вашому імпонує кількість нецензурної лексики
""")
PROMO = _words("билет концерт sollt промокод скидк розыгрыш giveaway telegram whatsapp tiktok instagram инстаграм телеграм курс обучени заработ")

KAZAKH_RUSSIAN = LanguagePair(
    a="kk",
    b="ru",
    main_class="Ѐ-ӿ",
    other_class="a-zA-Z",
    script_names=("cyrillic", "latin"),
    letters_a=KK_LETTERS,
    letters_b=RU_LETTERS,
    func_a=KK_FUNCTION,
    func_b=RU_FUNCTION,
    stop_both=STOP_BOTH,
    shared_seed=SHARED_SEED,
    screen_a=SCREEN_KK,
    screen_b=SCREEN_RU,
    screen_shared=SCREEN_SHARED,
    accents=("әғқңөұүһій", "агкноуухии"),
    neighbours=(
        Neighbour("uk", UK_MARKERS, "їєґ"),
        Neighbour("uz", UZ_MARKERS, "ў"),
        Neighbour("ky", KY_MARKERS, "", ("(?:оо|өө|уу|үү)", "(?:нын|нин|нун|нүн)$")),
    ),
    evidence_letters="әғқһ",
    promo=PROMO,
)

#: A pair over Latin script, for corpora of Western European prose: French beside English.
FRENCH_ENGLISH = LanguagePair(
    a="fr",
    b="en",
    main_class="a-zA-ZÀ-ÖØ-öø-ÿ",
    other_class="Ѐ-ӿ",
    script_names=("latin", "cyrillic"),
    letters_a="éèêëàâçùûîïœ",
    letters_b="w",
    func_a=_words("le la les des du un une et est que qui dans pour pas sur par au elle avec son ne ce il"),
    func_b=_words("the of and to is that it for with as are this be was by from at or"),
    stop_both=_words("a on in me"),
    shared_seed=_words("table station nation"),
    screen_a=_words("le la les de des du un une et est en que qui dans pour pas sur par au elle avec on"),
    screen_b=_words("the of and to in is that it for on with as are this be was by from at or de"),
    screen_shared=_words("tion table"),
    accents=("éèêëàâçùûîï", "eeeeaacuuii"),
    neighbours=(
        Neighbour("es", _words("las los para como del este pero"), "ñ"),
        Neighbour("de", _words("der die das und nicht ein eine mit dem"), "ßäöü", ("(?:keit|heit|ung)$",)),
    ),
    evidence_letters="êç",
    promo=_words("ticket concert promo giveaway telegram whatsapp"),
)
