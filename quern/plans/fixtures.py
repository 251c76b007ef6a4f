"""Weather reports and forecasts of our own, for the record operators."""

METARS = [
    (1, "METAR LFPG 121230Z 24012G25KT 9999 FEW030 SCT045CB 18/12 Q1015 NOSIG"),
    (2, "SPECI EGLL 010050Z VRB03KT 0800 FG VV002 M02/M03 Q0998"),
    (3, "KJFK 211851Z AUTO 31015KT 10SM CLR 25/10 A2992 RMK AO2 SLP132"),
    (4, "METAR COR EDDF 050520Z 00000KT CAVOK 05/02 Q1023 TEMPO 3000 BR"),
    (5, "METAR UUEE 050500Z 18005MPS 3000 -SN BKN006 OVC012 M11/M13 Q1009"),
    (6, "KORD 300000Z 09010KT 1 1/2SM BR OVC004 12/14 A3001"),
    (7, "METAR LEMD 301200Z 27020G15KT 9999 BKN040 FEW010 31/08 Q1012"),
    (8, "garbled report text"),
    (9, "METAR NZAA 151400Z 20008KT 9999 +TSRA BKN020TCU 19/18 Q1101"),
    (10, "EHAM 151425Z 23015KT 6000 RA SCT008 BKN012 10/09 Q1002 BECMG CAVOK"),
    (11, ""),
    (12, "KSFO 151456Z 28008KT 1/2SM FG VV001 11/11 A2995"),
]
TAFS = [
    (1, "TAF LFPG 121100Z 1212/1318 24012KT 9999 SCT030 BECMG 1215/1217 27015G25KT TEMPO 1218/1222 3000 SHRA BKN010CB"),
    (2, "TAF AMD KJFK 121720Z 1218/1324 31015G22KT P6SM FEW250 FM130000 33008KT P6SM SKC PROB30 1306/1310 2SM BR OVC004"),
    (3, "TAF EGLL 010500Z NIL"),
    (4, "TAF COR EDDF 050500Z 0506/0612 CAVOK PROB40 TEMPO 0510/0514 1500 TSRA BKN012CB"),
    (5, "nonsense"),
]
