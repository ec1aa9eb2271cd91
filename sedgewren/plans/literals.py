"""Texts with the characters that the test tables lack."""

CJK_LITERALS = (
    "打开设备Device 2，重启。OK",
    "ＡＢＣ全角１２３、标点？",
    "a😀b x_y Ünïcode",
    "中文English混排test中文",
    "",
    "。！？；",
    "non breaking　space",
    "㐀𠀀扩展",
)
