"""Fixed values of the phrase dictionary: a pattern, what may stand for it, and whether that is mere variation."""

from __future__ import annotations

# Patterns are bounded by words; capitals count where the last entry says so.
PHRASES = {
    "en": [
        ("don't", ["do not"]),
        ("doesn't", ["does not"]),
        ("didn't", ["did not"]),
        ("isn't", ["is not"]),
        ("aren't", ["are not"]),
        ("wasn't", ["was not"]),
        ("weren't", ["were not"]),
        ("can't", ["cannot"]),
        ("won't", ["will not"]),
        ("wouldn't", ["would not"]),
        ("shouldn't", ["should not"]),
        ("couldn't", ["could not"]),
        ("hasn't", ["has not"]),
        ("haven't", ["have not"]),
        ("it's", ["it is"]),
        ("there's", ["there is"]),
        ("they're", ["they are"]),
        ("we're", ["we are"]),
        ("we'll", ["we will"]),
        ("let's", ["let us"]),
        ("it is important to note that", ["notably,", "importantly,"]),
        ("it should be noted that", ["notably,"]),
        ("it is worth noting that", ["notably,"]),
        ("it is worth mentioning that", ["notably,"]),
        ("it must be emphasi[sz]ed that", ["critically,"]),
        ("it goes without saying that", ["clearly,"]),
        ("needless to say", ["clearly"]),
        ("as a matter of fact", ["in fact"]),
        ("due to the fact that", ["because"]),
        ("owing to the fact that", ["because"]),
        ("in spite of the fact that", ["although"]),
        ("despite the fact that", ["although"]),
        ("in the event that", ["if"]),
        ("in order to", ["to"]),
        ("for the purpose of", ["to"]),
        ("with the exception of", ["except for"]),
        ("at this point in time", ["currently"]),
        ("at the present time", ["currently"]),
        ("in the near future", ["soon"]),
        ("a large number of", ["many"]),
        ("a small number of", ["few"]),
        ("the majority of", ["most"]),
        ("a wide range of", ["various", "a range of"]),
        ("has the ability to", ["can"]),
        ("have the ability to", ["can"]),
        ("is able to", ["can"]),
        ("are able to", ["can"]),
        ("take into consideration", ["consider"]),
        ("give consideration to", ["consider"]),
        ("conduct an analysis of", ["analyse"]),
        ("perform an evaluation of", ["evaluate"]),
        ("make a decision", ["decide"]),
        ("in close proximity to", ["near"]),
        ("prior to", ["before"]),
        ("subsequent to", ["after"]),
        ("on a regular basis", ["regularly"]),
        ("in the majority of cases", ["usually"]),
        ("delve into", ["examine", "analyse"]),
        ("delves into", ["examines", "analyses"]),
        ("delving into", ["examining"]),
        ("plays a key role", ["is central"]),
        ("plays a crucial role", ["is central"]),
        ("plays an important role", ["is important"]),
        ("a testament to", ["evidence of"]),
        ("cutting-edge", ["advanced"]),
        ("state-of-the-art", ["advanced"]),
        ("game-changing", ["significant"]),
        ("revolutioni[sz]e", ["transform"]),
        ("seamlessly", ["smoothly"]),
        ("seamless", ["smooth"]),
        ("leverages", ["uses"]),
        ("leveraging", ["using"]),
        ("leverage", ["use"]),
        ("utili[sz]ation", ["use"]),
        ("utili[sz]es", ["uses"]),
        ("utili[sz]ed", ["used"]),
        ("utili[sz]ing", ["using"]),
        ("utili[sz]e", ["use"]),
        ("in the realm of", ["in"]),
        ("in today's world", ["currently"]),
        ("in today's fast-paced world", ["currently"]),
        ("navigate the complexities of", ["address"]),
        ("unlock the potential of", ["realise the potential of"]),
        ("holistic approach", ["comprehensive approach"]),
        ("paradigm shift", ["fundamental change"]),
        ("moving forward", ["in future periods"]),
        ("at the end of the day", ["ultimately"]),
        ("moreover,", ["In addition,", "Also,"], "varied", "open"),
        ("furthermore,", ["In addition,", "Beyond that,"], "varied", "open"),
        ("additionally,", ["In addition,", "Also,"], "varied", "open"),
        ("well-positioned to", ["able to"]),
        ("commences", ["begins"]),
        ("commence", ["begin"]),
        ("commenced", ["began"]),
        ("commencement", ["start"]),
        ("facilitates", ["supports"]),
        ("facilitate", ["support"]),
        ("facilitated", ["supported"]),
        ("demonstrates", ["shows"]),
        ("demonstrate", ["show"]),
        ("demonstrated", ["showed"]),
        ("endeavours", ["aims"]),
        ("endeavour", ["aim"]),
        ("terminates", ["ends"]),
        ("terminate", ["end"]),
        ("terminated", ["ended"]),
        ("sufficient", ["enough"]),
        ("numerous", ["many"]),
        ("approximately", ["about"]),
        ("with regard to", ["about"]),
        ("with respect to", ["about"]),
        ("in relation to", ["about"]),
        ("subsequently", ["later"]),
        ("a number of", ["several"]),
        ("ascertain", ["establish"]),
        ("initiates", ["starts"]),
        ("initiate", ["start"]),
        ("initiated", ["started"]),
        ("endeavours to", ["aims to"]),
        ("in the vicinity of", ["near"]),
        ("notwithstanding", ["despite"]),
        ("heretofore", ["until now"]),
        ("thereafter", ["after that"]),
        ("a comprehensive framework", ["a framework"]),
        ("comprehensive framework", ["framework"]),
        ("proactive risk management", ["risk management"]),
        ("strategic goals", ["goals"]),
        ("is well-positioned to", ["can"]),
        ("are well-positioned to", ["can"]),
        ("significant market share", ["market share"]),
        ("rigorous monitoring of", ["monitoring of"]),
        ("the structured implementation approach", ["the implementation plan"]),
        ("structured implementation approach", ["implementation plan"]),
        ("in a dynamic environment", ["as conditions change"]),
        ("data-driven decision-making", ["decisions based on data"]),
        ("key stakeholders", ["stakeholders"]),
        ("core competencies", ["strengths"]),
        ("the competitive landscape", ["the market"]),
        ("competitive landscape", ["market"]),
        ("significant potential", ["potential"]),
        ("plays a pivotal role", ["is central"]),
        ("going forward", ["in future periods"]),
        ("a robust solution", ["a reliable solution"]),
        ("robust solution", ["reliable solution"]),
        ("drive significant", ["increase"]),
        ("a lot of", ["many"]),
        ("lots of", ["many"]),
        ("very important", ["critical"]),
        ("very significant", ["substantial"]),
        ("very large", ["substantial"]),
        ("really important", ["important"]),
        ("pretty much", ["largely"]),
        ("Furthermore,", ["In addition,", "Also,"], "varied", "cased", "open"),
        ("Moreover,", ["In addition,", "Also,"], "varied", "cased", "open"),
        ("Additionally,", ["In addition,", "Also,"], "varied", "cased", "open"),
        ("In conclusion,", ["Overall,", "To conclude,"], "varied", "cased", "open"),
        ("In summary,", ["Overall,", "In brief,"], "varied", "cased", "open"),
        ("Thus,", ["Therefore,", "Consequently,"], "varied", "cased", "open"),
        ("Hence,", ["Therefore,", "As a result,"], "varied", "cased", "open"),
    ],
    "ru": [
        ("в современном мире важно отметить, что", ["сейчас"]),
        ("таким образом, можно сделать вывод о том, что", ["следовательно,"]),
        ("таким образом, можно сделать вывод, что", ["следовательно,"]),
        ("подводя итог, можно сказать, что", ["в итоге"]),
        ("можно сделать вывод о том, что", ["отсюда следует, что"]),
        ("можно сделать вывод, что", ["отсюда следует, что"]),
        ("это свидетельствует о том, что", ["это показывает, что"]),
        ("в целом можно отметить, что", ["в целом"]),
        ("в рамках данного исследования", ["в этом исследовании"]),
        ("в рамках данного проекта", ["в этом проекте"]),
        ("в рамках данной работы", ["в этой работе"]),
        ("в рамках исследования", ["в исследовании"]),
        ("в рамках проекта", ["в проекте"]),
        ("в рамках работы", ["в работе"]),
        ("в процессе проведения анализа", ["при анализе"]),
        ("в ходе проведённого исследования", ["в исследовании"]),
        ("оказывает существенное влияние на", ["существенно влияет на"]),
        ("оказывает значительное влияние на", ["заметно влияет на"]),
        ("оказывает влияние на", ["влияет на"]),
        ("предоставляет возможность", ["позволяет"]),
        ("даёт возможность", ["позволяет"]),
        ("позволяет обеспечить", ["обеспечивает"]),
        ("представляется целесообразным", ["целесообразно"]),
        ("в конечном итоге", ["в итоге"]),
        ("наиболее оптимальн", ["оптимальн"], "open"),
        ("данное исследование", ["это исследование"]),
        ("данная работа", ["эта работа"]),
        ("данный проект", ["этот проект"]),
        ("данный подход", ["этот подход"]),
        ("данный метод", ["этот метод"]),
        ("данная проблема", ["эта проблема"]),
        ("данный вопрос", ["этот вопрос"]),
        ("в современном мире", ["сейчас"]),
        ("неотъемлемой частью", ["составной частью"]),
        ("важно отметить, что", ["отметим, что"]),
        ("следует отметить, что", ["отметим, что"]),
        ("необходимо отметить, что", ["отметим, что"]),
        ("стоит подчеркнуть, что", ["подчеркнём, что"]),
        ("нельзя не отметить, что", ["отметим, что"]),
        ("в связи с тем, что", ["поскольку"]),
        ("в силу того, что", ["поскольку"]),
        ("несмотря на то, что", ["хотя"]),
        ("в случае, если", ["если"]),
        ("с целью", ["для"]),
        ("в настоящее время", ["сейчас"]),
        ("на сегодняшний день", ["сейчас"]),
        ("большое количество", ["множество"]),
        ("принимая во внимание", ["учитывая"]),
        ("осуществляется", ["выполняется"]),
        ("является важным", ["важен"]),
        ("играет ключевую роль", ["имеет ключевое значение"]),
        ("широкий спектр", ["ряд"]),
        ("в заключение можно сказать, что", ["в итоге"]),
        ("в связи с этим,", ["Поэтому,", "По этой причине,"], "varied", "open"),
        ("следует сказать, что", ["отметим, что"]),
        ("подводя итог", ["в итоге"]),
        ("в заключение,", ["в итоге,"], "open"),
        ("можно сделать вывод, что", ["отсюда следует, что"]),
        ("не подлежит сомнению", ["не вызывает сомнений"]),
        ("кроме того,", ["помимо этого,", "наряду с этим,"], "varied", "open"),
        ("более того,", ["к тому же,", "кроме того,"], "varied", "open"),
        ("обеспечивает возможность (?=[\\p{L}]+ть(?![\\p{L}]))", ["позволяет "], "open"),
        ("обеспечивают возможность (?=[\\p{L}]+ть(?![\\p{L}]))", ["позволяют "], "open"),
        ("предоставляет возможность (?=[\\p{L}]+ть(?![\\p{L}]))", ["позволяет "], "open"),
        ("имеется возможность (?=[\\p{L}]+ть(?![\\p{L}]))", ["можно "], "open"),
        ("осуществление контроля", ["контроль"]),
        ("осуществления контроля", ["контроля"]),
        ("оказывающих воздействие на", ["влияющих на"]),
        ("оказывающие воздействие на", ["влияющие на"]),
        ("оказывающих влияние на", ["влияющих на"]),
        ("на основании полученных данных", ["по этим данным"]),
        ("на основании данных", ["по данным"]),
        ("можно сделать вывод, что", ["значит,"]),
        ("можно сделать вывод о том, что", ["значит,"]),
        ("наличие ряда факторов", ["несколько факторов"]),
        ("ряд факторов", ["несколько факторов"]),
        ("при наличии", ["если есть"]),
        ("в случае отсутствия", ["без"]),
        ("для того чтобы", ["чтобы"]),
        ("для того, чтобы", ["чтобы"]),
        ("по причине", ["из-за"]),
        ("является одним из", ["один из"]),
        ("являются одними из", ["одни из"]),
        ("значительное количество", ["много"]),
        ("достаточно большое количество", ["много"]),
        ("был проведён анализ", ["анализ провели"]),
        ("был проведен анализ", ["анализ провели"]),
        ("было проведено исследование", ["исследование провели"]),
        ("были получены результаты", ["результаты получили"]),
        ("в рамках проведения", ["при"]),
        ("с целью обеспечения", ["ради"]),
        ("в целях обеспечения", ["ради"]),
        ("способствует повышению", ["повышает"]),
        ("способствует снижению", ["снижает"]),
        ("приводит к необходимости", ["требует"]),
        ("существует необходимость", ["нужно"]),
        ("в первую очередь,", ["прежде всего,"], "varied", "open"),
        ("таким образом,", ["следовательно,", "итак,"], "varied", "open"),
    ],
}
