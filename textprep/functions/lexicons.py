"""Phrase lists.

Fixed values: results depend on these exact strings.
"""

ENGLISH_NEGATIVE = [
    "no hope",
    "not much hope",
    "little hope",
    "without hope",
    "hopeless",
    "don't have hope",
    "do not have hope",
    "not hope",
]

ENGLISH_POSITIVE = [
    "there is hope",
    "i have hope",
    "we have hope",
    "never lose hope",
    "don't lose hope",
    "do not lose hope",
    "never give up hope",
    "keep hope alive",
    "stay hopeful",
    "things will be good",
    "better days are coming",
    "have hope",
]

MALAYALAM_NEGATIVE = [
    "ഇല്ല",
    "നഷ്ടപ്പെട്ടു",
    "കിടയില്ല",
    "മാർഗ്ഗമില്ല",
    "മുട്ടി",
    "സാധ്യമല്ല",
]

MALAYALAM_POSITIVE = [
    "ആശയുണ്ട്",
    "വിജയിക്കും",
    "വിജയം",
    "നല്ല ദിവസം",
    "വിശ്വസിക്കുന്നു",
]

TAMIL_HOPE_WORD = "நம்பிக்கை"

TAMIL_NEGATIONS = ["இல்லை", "இல்ல", "கிடையாது", "மாட்டேன்"]
