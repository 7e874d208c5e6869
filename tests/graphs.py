"""Small texts that the tests share."""

#: A made-up river: one spring, two ways down, two mouths. Three walks have a read each; q14 starts half way.
RIVER = """# all words are made up
H\tTSG\t1.0
H origin invented
N spring chr7:-:310-355 q11:SO,q12:SO,q13:SO GATTACA
N\tford\tchr7:-:400-480,520-560\tq11:IN,q12:IN\tCCGGT
  N weir chr7:-:600-644 q13:IN,q14:SO TTAA
N delta chr7:+:700-790 q11:SI,q13:SI,q14:SI GGC
N marsh chr9:+:15-60,75-99,120-121 q12:SI AAAC

E bend spring ford chr7,chr7,355,400,DEL
E race spring weir chr7,chr7,355,600,INV
E mouth ford delta chr7,chr7,560,700,TDUP
E leak ford marsh chr7,chr9,560,15,TRA
E lock weir delta chr7,chr7,644,700,splice
C main spring bend ford mouth delta
P walk spring+ bend+ ford+ leak+ marsh-
U wet weir marsh delta
A N ford depth:f:3.25 rank:i:7
A P walk score:f:0.5
A E leak why:Z:x:y:z
"""

TWO_GRAPHS = """H TSG 1.0
G g1 name:Z:first
N a c1:+:10-20 r1:SO AC
N b c1:+:30-40 r1:SI GT
E x a b c1,c1,20,30,splice
G g2
N a c2:-:10-20 r2:SO,r3:SO AA
N b c2:-:30-40 r2:SI CC
N c c2:-:50-60 r3:SI GG
E x a b c2,c2,20,30,splice
E y a c c2,c2,20,50,splice
L l1 g1:a g2:b same note:Z:x
"""

#: A diamond with a bar: its two arms are joined, so three pairs of walks have common ends.
DIAMOND = """N north c:+:11-21 k1:SO,k2:SO,k3:SO A
N west c:+:31-41 k1:IN,k2:IN C
N east c:+:51-61 k2:IN,k3:IN G
N south c:+:71-81 k1:SI,k2:SI,k3:SI T
E nw north west c,c,21,31,splice
E ne north east c,c,21,51,splice
E bar west east c,c,41,51,splice
E ws west south c,c,41,71,splice
E es east south c,c,61,71,splice
"""
