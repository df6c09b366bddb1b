"""Lookup tables of gloss tags."""

from __future__ import annotations

#: Gloss tag, feature, value (fixed values; a tag may stand on several lines).
GLOSS_TAGS = """
obj CASE OBJ
acc CASE ACC
lat CASE LAT
dat CASE DAT
gen CASE GEN
nom CASE NOM
poss GRAM_REL POSS
sg NUMBER SG
pl NUMBER PLUR
du NUMBER DU
1 PERSON 1
2 PERSON 2
3 PERSON 3
pres TENSE PRES
past TENSE PST
fut TENSE FUT
perf ASPECT PERF
prog ASPECT PROG
imp MOOD IMP
pass VOICE PASS
fem GENDER FEM
masc GENDER MASC
def DEFINITE DEF
ins CASE INS
sim ASPECT SIM
1sg PERSON 1
1sg NUMBER SG
2sg PERSON 2
2sg NUMBER SG
3sg PERSON 3
3sg NUMBER SG
1pl PERSON 1
1pl NUMBER PLUR
2pl PERSON 2
2pl NUMBER PLUR
3pl PERSON 3
3pl NUMBER PLUR
loc CASE LOC
1poss PERSON 1
1poss GRAM_REL POSS
2poss PERSON 2
2poss GRAM_REL POSS
3poss PERSON 3
3poss GRAM_REL POSS
foc FOCUS FOC
irr MOOD IRR
neg POLARITY NEG
ben VOICE BEN
prox DEICTIC PROX
dist DEICTIC DIST
nfin FINITENESS NONFIN
"""


def gloss_tags(spark):
    """tag, feature, value as a DataFrame."""
    return spark.createDataFrame([tuple(x.split()) for x in GLOSS_TAGS.split("\n") if x], "tag string, feature string, value string")
