"""Public sequences and spectra for tests."""

#: Bovine serum albumin, UniProt P02769.
ALBUMIN = "MKWVTFISLLLLFSSAYSRGVFRRDTHKSEIAHRFKDLGEEHFKGLVLIAFSQYLQQCPFDEHVKLVNELTEFAKTCVADESHAGCEKSLHTLFGDELCKVASLRETYGDMADCCEKQEPERNECFLSHKDDSPDLPKLKPDPNTLCDEFKADEKKFWGKYLYEIARRHPYFYAPELLYYANKYNGVFQECCQAEDKGACLLPKIETMREKVLASSARQRLRCASIQKFGERALKAWSVARLSQKFPKAEFVEVTKLVTDLTKVHKECCHGDLLECADDRADLAKYICDNQDTISSKLKECCDKPLLEKSHCIAEVEKDAIPENLPPLTADFAEDKDVCKNYQEAKDAFLGSFLYEYSRRHPEYAVSVLLRLAKEYEATLEECCAKDDPHACYSTVFDKLKHLVDEPQNLIKQNCDQFEKLGEYGFQNALIVRYTRKVPQVSTPTLVEVSRSLGKVGTRCCTKPESERMPCTEDYLSLILNRLCVLHEKTPVSEKVTKCCTESLVNRRPCFSALTPDETYVPKAFDEKLFTFHADICTLPDTEKQIKKQTALVELLKHKPKATEEQLKTVMENFVAFVDKCCAADDKEACFAVEGPKLVVSTQTALA"
#: (m/z, intensity) of a predicted spectrum of VPQVSTPTLVEVSR/2; doubly charged fragments follow the singly charged ones.
SAMPLE_PEAKS = [(175.118952167, 0.1152), (197.128454467, 0.1255), (262.150980167, 0.0419), (325.187032467, 0.6336), (361.219394167, 0.1023), (424.255446467, 0.1067), (490.261987167, 0.0708), (511.287474467, 0.0177), (589.330401167, 0.0663), (612.335153467, 0.0093), (702.414465167, 0.0395), (803.462144167, 0.0488), (900.514908167, 0.9806), (1001.562587167, 0.2816), (1088.594615167, 1.0), (1187.663029167, 0.5382), (1315.721607167, 0.2381), (1412.774371167, 0.018), (450.761092317, 0.0337), (706.890823817, 0.1398)]
SAMPLE_PRECURSOR = 756.4250
