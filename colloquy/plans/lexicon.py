"""Word lists, one for each category, and the rule tables that read them. All of them can be replaced by the caller.

Words are counted as substrings, so a word that holds another counts for both.
"""

from __future__ import annotations

#: Own lists for interviews in Chinese.
WORDS: dict[str, tuple[str, ...]] = {
    "action": ("推进", "落地", "拍板", "完成", "验证", "改了", "写了", "执行"),
    "emotional": ("担心", "兴奋", "压力", "满意", "开心", "焦虑"),
    "social": ("沟通", "配合", "大家", "团队", "协作"),
    "certainty": ("必须", "一定", "肯定", "绝对"),
    "hedge": ("可能", "也许", "有点", "大概"),
    "achievement": ("提升", "降低", "目标", "突破", "成果"),
    "process": ("流程", "复盘", "步骤", "方案", "总结"),
    "detail": ("数据", "文档", "接口", "具体", "订单"),
    "risk": ("风险", "边界", "隐患", "问题"),
    "imperative": ("必须", "马上", "立即", "要求"),
    "qualifier": ("如果", "通常", "一般", "相对"),
    "modal": ("可以", "应该", "会", "能"),
    "logical": ("因为", "所以", "然后", "因此"),
    "contrast": ("但是", "不过", "然而", "其实"),
    "abstract": ("体系", "战略", "价值", "闭环"),
    "buzzword": ("闭环", "全链路", "体系化", "赋能"),
    "quantitative": ("%", "万元", "倍", "个百分点"),
    "temporal": ("当时", "最后", "之后", "时间"),
    "constraint": ("时间紧", "复杂", "限制", "不清"),
    "vague_result": ("不错", "很好", "满意", "还行"),
    "tool_method": ("文档", "接口", "模型", "工具"),
    "step_connector": ("首先", "其次", "然后", "最后"),
    "context_marker": ("背景", "当时", "项目", "情况"),
    "self_result": ("我负责", "我完成", "我直接", "我写"),
    "team_result": ("我们完成", "团队完成", "我们团队", "大家"),
    "reflection": ("复盘", "总结", "反思"),
    "singular": ("我",),
    "plural": ("我们", "咱们"),
    "second": ("你", "您"),
    "third": ("他", "她", "它"),
    "adjective": ("很", "紧", "清", "好"),
    "star_s": ("背景", "当时", "情况", "项目"),
    "star_t": ("任务", "目标", "负责", "职责"),
    "star_a": ("分析", "推进", "验证", "拍板", "改了", "写了"),
    "star_r": ("结果", "提升", "降低", "效果"),
    "weak_s": ("之前", "有一次"),
    "weak_t": ("目标", "需要"),
    "weak_a": ("参与", "协助", "配合"),
    "weak_r": ("不错", "满意", "还行"),
    "counter_s": ("总的来说",),
    "counter_t": ("随便",),
    "counter_a": ("大家",),
    "counter_r": ("没有结果", "不错"),
    "disc_d": ("拍板", "必须", "马上", "目标"),
    "disc_i": ("大家", "沟通", "兴奋", "满意"),
    "disc_s": ("配合", "一起", "团队", "流程"),
    "disc_c": ("分析", "数据", "流程", "文档"),
    "pos_o": ("体系", "验证", "方案"), "neg_o": ("照旧",),
    "pos_c": ("流程", "复盘", "文档"), "neg_c": ("随便",),
    "pos_e": ("沟通", "大家", "兴奋"), "neg_e": ("独自",),
    "pos_a": ("配合", "一起", "团队"), "neg_a": ("拍板",),
    "pos_n": ("担心", "压力", "风险"), "neg_n": ("满意",),
    "type_1": ("流程", "必须"), "type_2": ("大家", "配合"), "type_3": ("目标", "提升"),
    "type_4": ("感受", "独特"), "type_5": ("分析", "数据"), "type_6": ("风险", "担心"),
    "type_7": ("兴奋", "有趣"), "type_8": ("拍板", "直接"), "type_9": ("一起", "满意"),
    "side_e": ("大家", "沟通"), "side_i": ("独自", "思考"), "side_n": ("体系", "闭环"), "side_s": ("数据", "文档"),
    "side_t": ("分析", "因为"), "side_f": ("担心", "满意"), "side_j": ("流程", "首先"), "side_p": ("可能", "如果"),
}

#: Stems of the invented prose in the test tables, so that counts there are not trivial.
STEMS: dict[str, tuple[str, ...]] = {
    "action": ("ing", "ción"), "emotional": ("oi", "ñ"), "social": ("and", "und"), "certainty": ("ver",), "hedge": ("or ", "ou"),
    "achievement": ("tion", "ung"), "process": ("the", "der"), "detail": ("er ", "en "), "risk": ("st",), "imperative": ("be",),
    "qualifier": ("ed ",), "modal": ("is", "ar"), "logical": ("ion", "ein"), "contrast": ("ea",), "abstract": ("an ", "le "),
    "buzzword": ("ble", "ß"), "temporal": ("to ",), "constraint": ("sh",), "tool_method": ("wh",), "step_connector": ("re ",),
    "context_marker": ("for",), "reflection": ("thin",), "singular": ("a ",), "plural": ("en",), "star_a": ("ha",), "star_t": ("for",),
    "disc_d": ("she",), "disc_i": ("ou",), "disc_s": ("ti",), "disc_c": ("nd",), "pos_o": ("oi",), "pos_e": ("and",), "neg_a": ("ß",),
    "type_3": ("ing",), "type_5": ("tion",), "type_9": ("and",), "side_e": ("and",), "side_s": ("er",), "side_t": ("ion",), "side_j": ("re",),
}


def with_stems() -> dict[str, tuple[str, ...]]:
    return {k: v + STEMS.get(k, ()) for k, v in WORDS.items()}


#: Jobs by their words; more hits win, the first of equals too.
JOBS = {
    "product": ("产品", "需求", "方案", "tion"),
    "sales": ("客户", "订单", "目标", "ing"),
    "engineering": ("接口", "文档", "数据", "der"),
    "operations": ("流程", "复盘", "效果", "que"),
}

#: Kinds of questions; the first that fits counts.
QUESTIONS = (
    ("failure", ("失败", "担心")),
    ("conflict", ("冲突", "拍板")),
    ("teamwork", ("团队", "配合")),
    ("result", ("结果", "效果")),
    ("method", ("流程", "首先")),
    ("motivation", ("为什么", "因为")),
    ("task", ("任务", "负责")),
    ("background", ("背景", "介绍")),
)

#: Numbers of the rules below are fixed values.
#: Big Five: base 40 and these blocks; conditions are over the feature columns.
BIGFIVE = {
    "O": (("abstraction = 'abstract'", 15), ("hedge_ratio >= 0.005", 10), ("qualifier_ratio >= 0.006", 8), ("process_ratio >= 0.006", 6), ("abstraction = 'grounded' and detail_ratio >= 0.010", -8)),
    "C": (("process_ratio >= 0.008", 15), ("detail_ratio >= 0.008", 12), ("structure >= 0.60", 10), ("logical_ratio >= 0.008", 8), ("qualifier_ratio >= 0.006", 5), ("hedge_ratio >= 0.010", -6)),
    "E": (("emotional_ratio >= 0.005", 15), ("social_ratio >= 0.006", 12), ("plural_ratio >= 0.006", 10), ("richness >= 0.55", 7), ("avg_sentence >= 15", 5), ("social_ratio < 0.005 and process_ratio >= 0.008", -10)),
    "A": (("plural_ratio >= 0.008", 15), ("social_ratio >= 0.006", 12), ("hedge_ratio >= 0.004", 8), ("contrast_ratio >= 0.006", -10), ("imperative_ratio >= 0.008", -8)),
    "N": (("emotional_ratio >= 0.007", 18), ("risk_ratio >= 0.006", 12), ("hedge_ratio >= 0.008", 8), ("certainty_ratio >= 0.006", -10), ("hedge_ratio < 0.003", -6)),
}
DISC = {
    "D": (("action_ratio >= 0.02", 18), ("achievement_ratio >= 0.015", 15), ("hedge_ratio <= 0.006", 8), ("focus = 'problem'", 8), ("qualifier_ratio >= 0.015", -10)),
    "I": (("social_ratio >= 0.018", 18), ("emotional_ratio >= 0.008", 15), ("plural_ratio >= 0.01", 10), ("richness >= 0.65", 6), ("abstraction = 'grounded' and social_ratio < 0.01", -8)),
    "S": (("stability >= 0.72", 15), ("orientation = 'team'", 18), ("balance = 'balanced'", 8), ("hedge_ratio >= 0.004 and hedge_ratio <= 0.015", 6), ("imperative_ratio >= 0.012", -10)),
    "C": (("logical_ratio >= 0.015", 18), ("detail_ratio >= 0.015", 15), ("structure >= 0.75", 12), ("qualifier_ratio >= 0.008", 8), ("stability < 0.55", -10)),
}
#: Enneagram: base 15; (feature, comparison, threshold, points). The comparison of a label with a number can never hold.
ENNEAGRAM = {
    1: (("certainty_ratio", ">=", 0.006, 16), ("process_ratio", ">=", 0.012, 14), ("imperative_ratio", ">=", 0.010, 12), ("qualifier_ratio", ">=", 0.008, 10), ("logical_ratio", ">=", 0.010, 10), ("hedge_ratio", "<=", 0.006, -12), ("buzzword_ratio", ">=", 0.010, -8)),
    2: (("social_ratio", ">=", 0.012, 18), ("emotional_ratio", ">=", 0.007, 14), ("plural_ratio", ">=", 0.010, 14), ("singular_ratio", ">=", 0.020, -8), ("imperative_ratio", ">=", 0.015, -10), ("achievement_ratio", ">=", 0.015, -6)),
    3: (("achievement_ratio", ">=", 0.015, 20), ("action_ratio", ">=", 0.020, 16), ("structure", ">=", 0.70, 14), ("singular_ratio", ">=", 0.018, 12), ("buzzword_ratio", ">=", 0.008, 10), ("hedge_ratio", "<=", 0.004, -12), ("question_ratio", "<=", 0.06, -8), ("plural_ratio", ">=", 0.015, -6)),
    4: (("singular_ratio", ">=", 0.025, 20), ("emotional_ratio", ">=", 0.010, 16), ("avg_sentence", ">=", 20, 12), ("plural_ratio", "<=", 0.006, -14), ("social_ratio", "<=", 0.008, -8), ("process_ratio", "<=", 0.008, -8)),
    5: (("detail_ratio", ">=", 0.015, 18), ("logical_ratio", ">=", 0.012, 16), ("process_ratio", ">=", 0.012, 14), ("qualifier_ratio", ">=", 0.010, 12), ("risk_ratio", ">=", 0.012, 12), ("avg_sentence", ">=", 20, 10), ("social_ratio", "<=", 0.008, -14), ("emotional_ratio", "<=", 0.005, -10), ("plural_ratio", "<=", 0.006, -10), ("imperative_ratio", "<=", 0.006, -8)),
    6: (("risk_ratio", ">=", 0.012, 20), ("hedge_ratio", ">=", 0.008, 16), ("qualifier_ratio", ">=", 0.012, 14), ("logical_ratio", ">=", 0.010, 12), ("plural_ratio", ">=", 0.010, 12), ("certainty_ratio", ">=", 0.010, -8), ("imperative_ratio", ">=", 0.015, -8), ("hedge_ratio", "<=", 0.003, -6)),
    7: (("emotional_ratio", ">=", 0.010, 18), ("hedge_ratio", ">=", 0.008, 16), ("avg_sentence", ">=", 20, 14), ("richness", ">=", 0.65, 12), ("singular_ratio", ">=", 0.018, 10), ("stability", "<=", 0.65, -8), ("detail_ratio", "<=", 0.010, -8), ("logical_ratio", "<=", 0.008, -8), ("risk_ratio", "<=", 0.006, -8)),
    8: (("imperative_ratio", ">=", 0.015, 20), ("certainty_ratio", ">=", 0.007, 16), ("singular_ratio", ">=", 0.022, 18), ("contrast_ratio", ">=", 0.008, 14), ("action_ratio", ">=", 0.020, 12), ("hedge_ratio", "<=", 0.004, -16), ("plural_ratio", ">=", 0.015, -8), ("social_ratio", "<=", 0.008, -8), ("qualifier_ratio", "<=", 0.005, -6)),
    9: (("plural_ratio", ">=", 0.014, 20), ("social_ratio", ">=", 0.014, 16), ("hedge_ratio", ">=", 0.010, 14), ("contrast_ratio", "<=", 0.004, -14), ("imperative_ratio", "<=", 0.005, -14), ("certainty_ratio", "<=", 0.005, -12), ("singular_ratio", ">=", 0.025, -8), ("action_ratio", ">=", 0.025, -6)),
}
#: MBTI sides: strong +25, soft +12, against -15. Numbers get a tolerance of 5 %.
MBTI = {
    "E": (("social_ratio >= 0.015", "plural_ratio >= 0.012", "orientation = 'team'"), ("richness >= 0.65", "question_ratio >= 0.08"), ("singular_ratio > 0.025", "social_ratio < 0.005")),
    "I": (("singular_ratio >= 0.018", "social_ratio < 0.008", "orientation = 'self'"), ("avg_sentence >= 25", "stability >= 0.70"), ("plural_ratio > 0.015", "emotional_ratio > 0.012")),
    "N": (("abstraction = 'abstract'", "abstract_ratio >= 0.008", "hedge_ratio >= 0.008"), ("qualifier_ratio >= 0.010", "detail_ratio < 0.012"), ("detail_ratio > 0.020", "structure > 0.85")),
    "S": (("detail_ratio >= 0.015", "abstraction = 'grounded'", "structure >= 0.75"), ("richness >= 0.70", "certainty_ratio >= 0.005"), ("abstract_ratio > 0.012", "hedge_ratio > 0.015")),
    "T": (("logical_ratio >= 0.015", "focus = 'problem'", "emotional_ratio < 0.006"), ("certainty_ratio >= 0.006", "detail_ratio >= 0.012"), ("emotional_ratio > 0.012", "focus = 'people'")),
    "F": (("emotional_ratio >= 0.010", "focus = 'people'", "social_ratio >= 0.012"), ("plural_ratio >= 0.010", "hedge_ratio >= 0.008"), ("logical_ratio > 0.020", "emotional_ratio < 0.004")),
    "J": (("structure >= 0.75", "action_ratio >= 0.018", "certainty_ratio >= 0.005"), ("stability >= 0.70", "qualifier_ratio < 0.008"), ("hedge_ratio > 0.012", "qualifier_ratio > 0.015")),
    "P": (("hedge_ratio >= 0.010", "qualifier_ratio >= 0.012", "action_ratio < 0.015"), ("question_ratio >= 0.08", "stability < 0.65"), ("certainty_ratio > 0.008", "structure > 0.80")),
}
AXES = (("E", "I"), ("N", "S"), ("T", "F"), ("J", "P"))

DISC_TO_BIGFIVE = {
    "D": {"C": 1.0, "E": 0.8, "A": -0.8, "N": -0.6, "O": 0.3},
    "I": {"E": 1.0, "A": 0.9, "O": 0.5, "N": -0.4, "C": -0.3},
    "S": {"A": 1.0, "N": 0.6, "C": 0.5, "E": -0.7, "O": -0.3},
    "C": {"C": 1.0, "O": 0.7, "N": -0.5, "A": 0.4, "E": -0.5},
}
DISC_TO_TYPE = {"D": ((3, 0.80), (8, 0.60), (1, 0.45)), "I": ((2, 0.85), (7, 0.60), (3, 0.50)), "S": ((9, 0.80), (2, 0.65), (6, 0.50)), "C": ((1, 0.80), (5, 0.65), (6, 0.55))}
BIGFIVE_TO_TYPE = (
    ("C >= 65 and N >= 55", 1, 0.85), ("C >= 65 and N <= 45", 3, 0.80), ("A >= 65 and N >= 55", 2, 0.75), ("A >= 65 and N <= 45 and E <= 50", 9, 0.80),
    ("A >= 60 and E >= 65", 2, 0.80), ("O >= 65 and E >= 65", 7, 0.80), ("O >= 65 and E <= 45", 4, 0.80), ("O >= 60 and C >= 60", 5, 0.75),
    ("N >= 65 and E <= 50 and O >= 55", 4, 0.70), ("N >= 60 and C >= 60", 6, 0.75), ("E >= 65 and C >= 60 and N >= 50", 3, 0.70), ("O >= 65 and C <= 45", 7, 0.70),
)
PATTERNS = (
    ("curious_and_orderly", "O >= 65 and C >= 65"), ("warm_and_outgoing", "E >= 65 and A >= 65"), ("orderly_and_tense", "C >= 65 and N >= 60"), ("orderly_and_calm", "C >= 65 and N <= 40"),
    ("curious_and_loose", "O >= 65 and C <= 45"), ("outgoing_and_firm", "E >= 65 and A <= 45"), ("warm_and_calm", "A >= 65 and N <= 40"), ("rich_story", "richness >= 0.7 and O >= 55 and C >= 55"),
)
UNLIKELY = {"D": "IFP", "I": "IT", "S": "ETJ", "C": "EFP"}
