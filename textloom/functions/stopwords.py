"""Pinned stop-word lists; operators take a list as a parameter and these are the defaults."""

ENGLISH = tuple(
    "about above after again against all also and any are because been before being below between both but can cannot "
    "could did does doing down during each few for from further had has have having her here hers herself him himself his "
    "how into its itself just more most myself nor not now off once only other our ours ourselves out over own same she "
    "should some such than that the their theirs them themselves then there these they this those through too under until "
    "very was were what when where which while who whom why will with would you your yours yourself yourselves".split()
)
SPANISH = tuple(
    "a al algo ante antes aquel aquella cada como con contra cual cuando cuya cuyo de del desde donde dos durante e el él ella ellas ellos entre era eran eres esa esas ese "
    "en eso esos esta estaba estado estamos estar estas este esto estos fue fueron fui ha han has hasta hay he la las le les lo los mas más me mi "
    "mí mis mucho muchos muy nada ni no nos nosotros nuestra nuestro o otra otras otro otros para pero poco por porque que qué quien se "
    "sea ser si sí sin sobre son soy su sus también tanto te tengo tiene tienen todo todos tu tú tus u un una unas uno unos usted vosotros y ya yo".split()
)


def sql_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)
