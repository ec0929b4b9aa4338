"""What the tests of this folder share."""



def words_of(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(n)]


def collect(df):
    return sorted((r.asDict() for r in df.collect()), key=repr)


