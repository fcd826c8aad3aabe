"""The compatible obfuscation against a plain version with its own table of a few syllables, and against bytes written
down."""

import hashlib
import random

import pytest

from glyphward.operators import obfuscate

#: A few syllables and their letters, by hand.
LETTERS_OF = {"가": "ga", "까": "kka", "닭": "dalg", "쉬": "swi", "없": "eobs", "힣": "hih", "의": "ui", "왕": "wang", "아": "a", "뷁": "bwelg"}
RUNE_OF = dict(zip("abcdefghijklmnopqrstuvwxyz", "ᚨᛒᚲᛞᛖᚠᚷᚺᛁᛃᚴᛚᛗᚾᛟᛈᛩᚱᛋᛏᚢᚡᚹᛪᚣᛉ"))
TEXTS = ["가까닭쉬없힣의왕아뷁" * 3, "가 나다 ABC 닭!\n왕", "", "plain text 123", "아아아이이하자 오", None]


def readable(text, seed, syllables, letters):
    """One draw for each syllable; if it falls below the share, one for each of its letters."""
    rng, out, seen, changed = random.Random(seed), "", 0, 0
    for char in text:
        if char not in LETTERS_OF:
            out += char
            continue
        seen += 1
        if rng.random() >= syllables:
            out += char
            continue
        changed += 1
        for letter in LETTERS_OF[char]:
            out += RUNE_OF[letter] if rng.random() < letters else letter
    return out, seen, changed


def test_readable_variants_equal_a_plain_version(spark):
    text = "가까닭쉬없힣의왕아뷁 x, y!" * 4
    rows = [(k, split, text[k:]) for k, split in enumerate(["train", "valid", "test", "test"])]
    found = {(r.idx, r.variant): (r.obfuscated, r.seen, r.changed) for r in obfuscate.obfuscate_compatible(spark.createDataFrame(rows, "idx int, split string, text string")).collect()}
    for k, split, t in rows:
        for name, syllables, letters, _ in obfuscate.READABLE:
            seed = f"20260604:{name}:{split}:{k}:{hashlib.sha256(t.encode()).hexdigest()}"
            assert found[k, name] == readable(t, seed, syllables, letters)
    assert len(found) == 16


@pytest.mark.parametrize("mix", [False, True])
def test_bytes(spark, mix):
    """As first written down; texts are invented."""
    rows = [(k, "test", t) for k, t in enumerate(TEXTS)]
    found = sorted((r.idx, r.variant, r.obfuscated) for r in obfuscate.obfuscate_compatible(spark.createDataFrame(rows, "idx int, split string, text string"), mix=mix).collect())
    assert found == WRITTEN[mix]


WRITTEN = {
    False: [
        (0, "roman_glyph_35", "가까닭쉬ᛖoᛒs힣의wanᚷ아뷁가까닭쉬없힣의왕아뷁가ᚴᚴᚨᛞᚨᛚᚷ쉬없ᚺiᚺuiwanᚷ아뷁"),
        (0, "roman_glyph_70", "gaᚴᚴadᚨlgᛋᚹiᛖᛟbᛋ힣uᛁ왕ᚨ뷁ᚷaᚴᚴadalgswieᛟbsᚺiᚺ의ᚹangaᛒᚹᛖᛚᚷgaᚴkadaᛚᚷᛋᚹiᛖᛟᛒᛋhᛁᚺ의ᚹangᚨ뷁"),
        (0, "romanized_35", "가까닭쉬없힣의왕아뷁gakka닭쉬없hih의왕abwelg가kka닭swi없힣의왕아뷁"),
        (0, "romanized_70", "가까dalg쉬eobshihuiwang아bwelg가kkadalgswieobshihuiwang아bwelggakkadalgswi없hihuiwang아bwelg"),
        (1, "roman_glyph_35", "가 nᚨᛞa ABC 닭!\n왕"),
        (1, "roman_glyph_70", "gᚨ nᚨᛞᚨ ABC 닭!\nwᚨᚾᚷ"),
        (1, "romanized_35", "가 나da ABC 닭!\nwang"),
        (1, "romanized_70", "가 nada ABC 닭!\nwang"),
        (2, "roman_glyph_35", ""),
        (2, "roman_glyph_70", ""),
        (2, "romanized_35", ""),
        (2, "romanized_70", ""),
        (3, "roman_glyph_35", "plain text 123"),
        (3, "roman_glyph_70", "plain text 123"),
        (3, "romanized_35", "plain text 123"),
        (3, "romanized_70", "plain text 123"),
        (4, "roman_glyph_35", "아아아i이하ja 오"),
        (4, "roman_glyph_70", "a아아ᛁihᚨjᚨ ᛟ"),
        (4, "romanized_35", "아aai이haja o"),
        (4, "romanized_70", "aaa이iha자 o"),
        (5, "roman_glyph_35", ""),
        (5, "roman_glyph_70", ""),
        (5, "romanized_35", ""),
        (5, "romanized_70", ""),
    ],
    True: [
        (0, "glyph_mix_35", "gᚨ까닭쉬없힣의왕a뷁ᚷaᚴkᚨ닭sᚹᛁᛖoᛒᛋ힣ᚢᛁ왕aᛒwelᚷ가까닭쉬eᛟᛒᛋhᛁᚺ의왕아bᚹelᚷ"),
        (0, "glyph_mix_90", "ᚷᚨᚴᚴᚨᛞᚨᛚᚷᛋᚹᛁeᛟᛒᛋᚺᛁᚺᚢᛁᚹᚨᚾgㅇrᛒᚹᛖᛚᚷᚷᚨᚴᚴᚨᛞᚨᛚᚷᛋᚹᛁᛖᛟbᛋᚺᛁᚺᚢᛁᚹᚨᚾᚷᚨᛒᚹᛖᛚᚷgᚨᚴᚴᚨᛞᚨᛚᚷᛋᚹᛁᛖᛟᛒᛋᚺᛁᚺᚢᛁᚹᚨᚾᚷᚨᛒᚹᛖᛚᚷ"),
        (1, "glyph_mix_35", "ᚷa ㄴrㄷr ᚨBC 닭!\n왕"),
        (1, "glyph_mix_90", "ᚷᚨ ㄴrㄷr ᚨᛒᚲ ᛞᚨᛚᚷ!\nᚹᚨᚾᚷ"),
        (2, "glyph_mix_35", ""),
        (2, "glyph_mix_90", ""),
        (3, "glyph_mix_35", "plᚨᛁn text 123"),
        (3, "glyph_mix_90", "ᛈᛚᚨᛁᚾ ᛏᛖᛪᛏ 123"),
        (4, "glyph_mix_35", "ᚨ아아이0l하자 오"),
        (4, "glyph_mix_90", "ᚨᚨᚨ0lᛁᚺᚨᛃᚨ ᛟ"),
        (5, "glyph_mix_35", ""),
        (5, "glyph_mix_90", ""),
    ],
}
