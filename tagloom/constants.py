"""Fixed values of the engine.

Everything below marked FIXED VALUES must equal the values the original workflow uses
for results to agree; they are stated plainly, in their natural order.
"""

# ---------------------------------------------------------------------------------
# FIXED VALUES: label dictionary (name -> id is the position in this list)
# ---------------------------------------------------------------------------------
ENTITY_LABELS = ["B-BANK", "I-BANK", "B-PRODUCT", "I-PRODUCT", "B-COMMENTS_N", "I-COMMENTS_N",
                 "B-COMMENTS_ADJ", "I-COMMENTS_ADJ", "O"]
SOS, EOS, PAD = "[SOS]", "[EOS]", "[PAD]"
ALL_LABELS = ENTITY_LABELS + [SOS, EOS, PAD]
SOS_ID, EOS_ID, PAD_ID = 9, 10, 11

# FIXED VALUES: maximum encoded length (two positions go to the frame labels)
MAX_SEQ_LEN = 200

# FIXED VALUES: default seed and batch size of the workflow
SEED = 118
BATCH_SIZE = 40

# FIXED VALUES: the response separator of back-translation answers and its error marker
RESPONSE_SEP = "#####"
RESPONSE_ERR = "ERR"

# FIXED VALUES: penalty of a forbidden transition
FORBIDDEN = -100.0

# ---------------------------------------------------------------------------------
# FIXED VALUES: bank alias lexicon, wide form (bank, cn, en), 50 rows in file order
# ---------------------------------------------------------------------------------
BANK_LEXICON_CSV = """\
bank,cn,en
中国工商银行,工行,ICBC
中国农业银行,农行,ABC
中国银行,中行,BOC
中国建设银行,建行,CCB
交通银行,交行,BoCom
中国邮政储蓄银行,邮储,PSBC
招商银行,招行,CMB
兴业银行,兴业,CIB
中信银行,中信,CITIC
华夏银行,华夏,HXB
上海浦东发展银行,浦发,SPDB
平安银行,平安,PingAnBank
民生银行,民生,CMBC
光大银行,光大,CEB
北京银行,北京,BOB
宁波银行,宁波,NB
江苏银行,江苏,JSB
杭州银行,杭州,HZB
广州银行,广州,GZB
浙商银行,浙商,ZSBank
重庆银行,重庆,CQB
武汉银行,武汉,WHB
成都银行,成都,CDB
南昌银行,南昌,NCB
福建海峡银行,海峡,HXB
青岛银行,青岛,QDB
大连银行,大连,DLB
西安银行,西安,XAB
河北银行,河北,HBB
河南银行,河南,HNB
吉林银行,吉林,JLB
辽宁银行,辽宁,LNB
新疆银行,新疆,XJB
陕西银行,陕西,SAB
安徽银行,安徽,AHB
广东发展银行,粤发,GDB
上海银行,上海,BOCShanghai
深圳发展银行,深发,SDB
赣州银行,赣州,GZB
泰隆银行,泰隆,TLBank
民间金融,民间,MF
上海农村商业银行,农商,SRCB
江苏省农村信用社,信用社,JXCU
内蒙古银行,内蒙古,IMB
海南银行,海南,HNB
宁夏银行,宁夏,NXBank
浙江农信,农信,ZNRC
甘肃银行,甘肃,GSB
广西北部湾银行,北部湾,BBAY
山东银行,山东,SDBank
"""

# ---------------------------------------------------------------------------------
# FIXED VALUES: added tokenizer vocabulary, one entry per line, file order (145 lines)
# ---------------------------------------------------------------------------------
ADDED_VOCAB_TEXT = """\
Aaa
ABC
AD
ae
Ae
AE
app
App
APP
applepay
atm
ATM
AUM
batch
bb
Bi
bilibili
binding
blabla
BNBTC
cc
Chao
CIP
CL
clear
Clear
credit
CS
Cut
cxk
Daikokuya
DIY
down
ed
ems
EMS
emv
EMV
ErrorCode
esh
etc
ETC
Find
first
First
flash
ga
giao
Giao
GQ
gt
gzh
HLB
hug
icbc
ID
II
JAL
jcb
JCB
JD
ji
joy
Joy
JOY
kf
kpi
Li
line
friends
lol
lu
lx
lz
mark
Mc
mcc
MCC
mini
MINI
MU
nb
NFC
Ngpe
nice
niubility
NND
ok
OK
omg
only
otg
pad
pass
pay
plus
pos
POS
PP
ps
PS
Pu
Putidu
QB
qq
RMB
ry
safari
sdk
Shaun
sim
SISI
smart
SMART
sos
tb
TM
TMD
TOP
tx
Tx
TX
UBS
Ukey
unbound
vip
visa
vtm
vvv
vx
vxzfb
wd
WD
word
xinyongka
XSZ
xu
xx
xxxx
xyk
YE
young
Young
YOUNG
zfb
"""

# ---------------------------------------------------------------------------------
# Lexicon used to derive BIO annotations for the driver's documents table.
# A letter island whose lower-cased word is a key gets B-/I- labels of that kind.
# ---------------------------------------------------------------------------------
CORPUS_LEXICON = {"that": "BANK", "was": "BANK", "for": "PRODUCT", "on": "PRODUCT",
                  "it": "COMMENTS_N", "are": "COMMENTS_ADJ"}
# Two letter islands with one blank between them form one mention, blank included.
CORPUS_PAIRS = {("of", "the"): "BANK", ("and", "the"): "PRODUCT", ("as", "the"): "COMMENTS_N",
                ("with", "the"): "COMMENTS_ADJ"}


def bank_lexicon_rows() -> list[tuple[str, str, str]]:
    lines = BANK_LEXICON_CSV.strip().splitlines()
    return [tuple(line.split(",")) for line in lines[1:]]


def added_vocab() -> list[str]:
    return [w.strip() for w in ADDED_VOCAB_TEXT.splitlines() if w.strip()]
