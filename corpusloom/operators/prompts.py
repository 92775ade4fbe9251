"""The default instructions of an annotation prompt; projects may give their own."""

from __future__ import annotations

INSTRUCTIONS = """Разметь комментарии к видео на смеси казахского и русского языков.

Для каждого комментария укажи:
- sentiment: pos, neg, neu или skip. Оценивай отношение автора, а не тему; эмодзи считаются; сарказм — по смыслу; сомнение — neu; skip — спам, ссылки и нечитаемый текст.
- base_lang: kk или ru, язык большинства значимых слов; общие заимствования и имена не считаются; при skip — пустая строка.
- confidence: high, если правило применимо однозначно, иначе low.
- note: при low — несколько слов о причине, иначе пустая строка.

Ответ — только JSON-массив объектов с полями id, sentiment, base_lang, confidence, note, по одному на комментарий и в том же порядке.
"""
