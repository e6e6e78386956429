"""Rule lists of text quality: written by ``python -m millrace.llm.quality_learn``, not by hand."""

RULES = [
    [
        ("junk", [("marks_token", ">", 0.292568), ("quotes_word", ">", 0.0034965), ("same_keys", ">", 0.393939), ("variety", "<=", 4.66578), ("tight_token", "<=", 0.272727)]),
        ("junk", [("common_word", "<=", 0.157444), ("mixed_word", ">", 0.0772276), ("inner_word", ">", 0.00555556), ("blanks", "<=", 0.11992)]),
        ("junk", [("common_word", "<=", 0.159599), ("same_keys", ">", 0.511905), ("closed", ">", 0.025), ("numbers_token", "<=", 0.0974067), ("keyed", "<=", 0.10101)]),
        ("junk", [("common_word", "<=", 0.158017), ("word_length", ">", 5.37817), ("words_line", ">", 21.5), ("separators_end", "<=", 0.0384615), ("numbers_token", "<=", 0.0125), ("bangs_word", "<=", 0.0185185)]),
        ("junk", [("marks_token", ">", 0.293873), ("quotes_word", ">", 0.00243902), ("same_lines", "<=", 0.958607), ("same_lines", "<=", 0.881944)]),
        ("junk", [("variety", "<=", 0.774865), ("words", "<=", 224.5), ("variety", "<=", 0.57735), ("assigned", "<=", 0.5)]),
        ("junk", [("marks_token", ">", 0.287586), ("ended", ">", 0.0336348), ("digits", "<=", 0.0635779), ("letters", "<=", 0.653312), ("glued_word", "<=", 0.0839202), ("ends_char", ">", 0.00348028)]),
        ("junk", [("same_keys", ">", 0.513158), ("token_length", ">", 7.27098), ("indents", ">", 0.3), ("ends_char", "<=", 0.0130445), ("bullets", "<=", 0.54375)]),
        ("junk", [("ends_char", "<=", 0.0200811), ("mixed_word", ">", 0.0913261), ("line_length", ">", 53.5714), ("words", ">", 52.0), ("letters", "<=", 0.680341)]),
        ("junk", [("same_keys", ">", 0.513158), ("assigned", ">", 0.0416667), ("assigned", "<=", 0.9), ("glued_word", ">", 0.0294118)]),
        ("junk", [("common_word", "<=", 0.139557), ("same_keys", ">", 0.513158), ("digits", ">", 0.0423986), ("token_length", ">", 6.52593), ("vowelless_word", ">", 0.033908), ("same_cells", ">", 0.267857), ("variety", ">", 2.94338)]),
        ("junk", [("common_word", "<=", 0.126102), ("closed", ">", 0.0616698), ("ends_char", ">", 0.00341619), ("closed", ">", 0.708333), ("blanks", ">", 0.160005), ("ends_char", "<=", 0.0614615)]),
        ("junk", [("latin_word", ">", 0.348485), ("bangs_word", "<=", 0.147619)]),
        ("junk", [("common_word", "<=", 0.137289), ("word_length", ">", 5.17544), ("same_lines", "<=", 0.240385), ("letters", ">", 0.847593), ("words_line", ">", 1.10684), ("keyed", "<=", 0.0625)]),
        ("junk", [("quotes_word", ">", 0.123106), ("variety", "<=", 3.15762), ("letters", "<=", 0.567647), ("line_length", ">", 47.5833)]),
        ("junk", [("variety", "<=", 0.876557), ("words", "<=", 325.0), ("same_parts", "<=", 0.232143), ("same_cells", ">", 0.01875), ("common_word", ">", 0.0345455)]),
        ("junk", [("common_word", "<=", 0.200418), ("bangs_word", ">", 0.535714), ("words", ">", 6.5)]),
        ("junk", [("ends_char", "<=", 0.019431), ("same_cells", ">", 0.261364), ("glued_word", ">", 0.124356), ("calls_word", ">", 0.00568182), ("token_length", "<=", 6.42679)]),
        ("junk", [("calls_word", ">", 0.189578), ("cells_char", "<=", 0.0305344)]),
        ("junk", [("ends_char", "<=", 0.0199029), ("same_cells", ">", 0.261364), ("glued_word", ">", 0.124356), ("dots_token", ">", 0.00714286), ("pipes", "<=", 1.35714)]),
        ("junk", [("ends_char", "<=", 0.0152093), ("same_cells", ">", 0.236111), ("marks_token", ">", 0.0493902), ("word_length", ">", 5.10913), ("lines", ">", 5.5), ("pipes", "<=", 0.857143)]),
        ("junk", [("mixed_word", ">", 0.207615), ("numbers_token", ">", 0.0294118), ("ends_char", "<=", 0.00747666), ("words", ">", 15.5)]),
        ("junk", [("variety", "<=", 3.71025), ("marks_token", ">", 0.326478), ("words", "<=", 18.5), ("same_keys", ">", 0.583333), ("keyed", "<=", 0.857143), ("token_length", ">", 6.47756), ("variety", "<=", 2.77101), ("word_length", ">", 4.3)]),
        ("junk", [("variety", "<=", 3.75002), ("quotes_word", ">", 0.103914), ("ended", "<=", 0.00819672), ("same_keys", ">", 0.333333), ("common_word", "<=", 0.201587)]),
        ("junk", [("variety", "<=", 0.957301), ("ends_char", ">", 0.00233645), ("numbers_token", "<=", 0.0242881), ("digits", ">", 0.0116193), ("marks_token", "<=", 0.0538462)]),
        ("junk", [("marks_token", ">", 0.134792), ("same_cells", ">", 0.348485), ("pipes", ">", 0.0909091)]),
        ("junk", [("words", "<=", 30.5), ("marks_token", ">", 0.0661202), ("closed", ">", 0.0625), ("words_line", ">", 7.83333), ("lines", "<=", 1.5), ("blanks", ">", 0.106854)]),
        ("junk", [("common_word", "<=", 0.200418), ("words", "<=", 29.5), ("marks_token", ">", 0.061553), ("words", "<=", 8.5), ("semicolons_word", ">", 0.1), ("marks_token", ">", 0.535714)]),
        ("junk", [("ends_char", "<=", 0.0203149), ("same_cells", ">", 0.211111), ("glued_word", ">", 0.111008), ("token_length", "<=", 5.2665), ("same_cells", ">", 0.583333), ("numbers_token", ">", 0.0192308), ("common_word", "<=", 0.313725)]),
        ("junk", [("line_length", "<=", 25.7574), ("glued_word", ">", 0.19887), ("same_cells", ">", 0.55), ("blanks", ">", 0.171569), ("marks_token", ">", 0.366667)]),
        ("junk", [("line_length", "<=", 15.2583), ("closed", ">", 0.0833333), ("lines", ">", 2.5)]),
        ("junk", [("ends_char", "<=", 0.0203218), ("word_length", ">", 5.14947), ("same_lines", "<=", 0.335417), ("line_length", "<=", 10.2576), ("words_line", ">", 1.08249), ("glued_word", "<=", 0.0576923)]),
        ("junk", [("words", "<=", 22.5), ("marks_token", ">", 0.0655914), ("ends_char", "<=", 0.0195127), ("marks_token", ">", 1.95455), ("same_keys", ">", 0.583333)]),
        ("junk", [("common_word", "<=", 0.125124), ("vowelless_word", ">", 0.0644469), ("clusters_word", ">", 0.225)]),
        ("junk", [("common_word", "<=", 0.125124), ("marks_token", ">", 0.0665459), ("words", "<=", 29.5), ("glued_word", ">", 0.224747), ("line_length", "<=", 24.125), ("glued_word", "<=", 0.25463), ("same_cells", ">", 0.75)]),
        ("junk", [("common_word", "<=", 0.125157), ("blanks", ">", 0.186434), ("line_length", "<=", 12.6125), ("token_length", ">", 5.625)]),
        ("junk", [("variety", "<=", 1.34397), ("ends_char", ">", 0.00401282), ("ended", "<=", 0.405128), ("words", "<=", 132.0), ("common_word", ">", 0.089527), ("words_line", ">", 4.5), ("semicolons_word", "<=", 0.166667)]),
        ("junk", [("marks_token", ">", 0.063783), ("words", "<=", 20.5), ("blanks", ">", 0.181513), ("letters", ">", 0.677693), ("dots_token", ">", 0.166667)]),
        ("junk", [("vowelless_word", ">", 0.0995868), ("same_keys", ">", 0.708333), ("blanks", "<=", 0.112257), ("glued_word", "<=", 0.233032), ("ended", "<=", 0.25)]),
        ("junk", [("ends_char", "<=", 0.0171748), ("same_cells", ">", 0.211111), ("glued_word", ">", 0.0999655), ("token_length", "<=", 5.45346), ("commas_word", ">", 0.0106383), ("commas_word", "<=", 0.15625), ("bangs_word", "<=", 0.0106383)]),
        ("table", [("letters", "<=", 0.59518), ("ends_char", "<=", 0.00552566), ("line_length", ">", 24.0492), ("variety", ">", 3.46814), ("lines", ">", 5.5)]),
        ("table", [("ends_char", "<=", 0.00283288), ("numbers_token", ">", 0.00847458), ("marks_token", ">", 0.00714286), ("letters", "<=", 0.712705), ("glued_word", ">", 0.00393701), ("marks_token", ">", 0.0917508), ("same_cells", "<=", 0.416667), ("bangs_word", "<=", 0.0120482)]),
        ("table", [("marks_token", ">", 1.20714), ("letters", "<=", 0.629938), ("words", ">", 16.5), ("ended", "<=", 0.666667)]),
        ("table", [("ends_char", "<=", 0.00455602), ("numbers_token", ">", 0.0444664), ("same_keys", ">", 0.0826503), ("same_keys", "<=", 0.55), ("words_line", "<=", 5.03125), ("marks_token", "<=", 0.435606)]),
        ("table", [("tight_token", ">", 0.289773)]),
        ("table", [("tabs", ">", 1.0)]),
        ("table", [("assigned", ">", 0.166667), ("ended", "<=", 0.261905)]),
        ("table", [("letters", "<=", 0.430791), ("gaps", ">", 0.0833333), ("ended", "<=", 0.5)]),
        ("table", [("closed", ">", 0.732143), ("ends_char", "<=", 0.00290698), ("inner_word", ">", 0.03125)]),
        ("table", [("ends_char", "<=", 0.000943396), ("numbers_token", ">", 0.0333704), ("inner_word", ">", 0.0116279), ("glued_word", "<=", 0.16928)]),
        ("table", [("pipes", ">", 2.16667)]),
        ("table", [("closed", ">", 0.732143), ("blanks", ">", 0.216844), ("ended", "<=", 0.261905)]),
        ("table", [("keyed", ">", 0.495833), ("line_length", "<=", 27.7917), ("numbers_token", ">", 0.0172414), ("letters", ">", 0.732406)]),
        ("list", [("ended", "<=", 0.0527778), ("same_cells", "<=", 0.211111), ("numbers_token", "<=", 0.00568182), ("words_line", "<=", 3.62132), ("same_cells", "<=", 0.105556)]),
        ("list", [("ended", "<=", 0.0178571), ("glued_word", ">", 0.00260417), ("separators_end", ">", 0.788889), ("slashes_word", ">", 0.00140449)]),
        ("list", [("ended", "<=", 0.0178571), ("marks_token", ">", 0.0142974), ("signs", "<=", 0.00833333), ("words_line", "<=", 3.98438), ("bullets", ">", 0.125)]),
        ("list", [("ended", "<=", 0.0178571), ("glued_word", ">", 0.0349857), ("same_keys", ">", 0.003125), ("glued_word", ">", 0.236291), ("same_lines", "<=", 0.958333)]),
        ("list", [("ended", "<=", 0.0178571), ("separators_end", ">", 0.788889), ("line_length", ">", 54.8333), ("separators_end", ">", 3.25), ("closed", "<=", 0.5)]),
        ("list", [("ended", "<=", 0.0178571), ("same_cells", "<=", 0.354167), ("words_line", "<=", 3.6125), ("numbered", ">", 0.465625)]),
        ("list", [("ended", "<=", 0.0178571), ("semicolons_word", ">", 0.0425532), ("quotes_word", "<=", 0.1)]),
        ("list", [("bullets", ">", 0.3875), ("lines", ">", 2.5), ("bullets", ">", 0.55)]),
        ("list", [("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.583333), ("words_line", "<=", 3.225), ("numbers_token", "<=", 0.0208333), ("common_word", ">", 0.0144928), ("variety", ">", 2.25193), ("words", "<=", 24.5)]),
        ("list", [("numbered", ">", 0.55), ("lines", ">", 1.5)]),
        ("list", [("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.55), ("numbers_token", "<=", 0.0113636), ("words_line", "<=", 3.6125), ("words_line", "<=", 2.6875), ("token_length", "<=", 5.84524)]),
        ("list", [("ends_char", "<=", 0.00094518), ("same_cells", "<=", 0.55), ("numbers_token", "<=", 0.0113636), ("glued_word", ">", 0.245), ("marks_token", ">", 0.291667)]),
        ("list", [("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.55), ("numbers_token", "<=", 0.0113636), ("words_line", "<=", 4.29167), ("token_length", "<=", 11.15), ("same_cells", "<=", 0.225), ("word_length", "<=", 4.39134), ("variety", ">", 0.955342)]),
        ("list", [("ends_char", "<=", 0.000943396), ("bullets", ">", 0.215909), ("marks_token", "<=", 0.363095), ("same_cells", "<=", 0.75)]),
        ("list", [("ends_char", "<=", 0.000990099), ("separators_end", ">", 3.5), ("variety", "<=", 3.28771)]),
        ("list", [("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.55), ("numbers_token", "<=", 0.0113636), ("words_line", "<=", 3.6125), ("same_parts", ">", 0.708333), ("line_length", "<=", 13.9167), ("letters", ">", 0.827407)]),
        ("list", [("ends_char", "<=", 0.000948767), ("keyed", ">", 0.0625), ("keyed", "<=", 0.504167), ("line_length", "<=", 32.4375), ("blanks", "<=", 0.193723)]),
        ("list", [("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.55), ("slashes_word", ">", 0.00524476), ("signs", "<=", 0.25)]),
        ("list", [("bullets", ">", 0.75), ("lines", ">", 1.5), ("commas_word", "<=", 0.214286)]),
        ("list", [("ends_char", "<=", 0.000943396), ("variety", ">", 3.00756), ("token_length", ">", 18.1), ("letters", "<=", 0.68515), ("gaps", "<=", 0.5)]),
        ("list", [("ends_char", "<=", 0.0122926), ("glued_word", ">", 0.0553007), ("keyed", ">", 0.928571), ("variety", ">", 3.42205)]),
        ("list", [("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.366667), ("word_length", ">", 4.02453), ("numbers_token", "<=", 0.016129), ("common_word", ">", 0.22619), ("line_length", "<=", 27.4167)]),
    ],
    [
        ("junk", [("marks_token", ">", 0.292568), ("quotes_word", ">", 0.00359712), ("same_keys", ">", 0.298701), ("variety", "<=", 4.66578), ("numbers_token", "<=", 0.1625)]),
        ("junk", [("common_word", "<=", 0.160507), ("vowelless_word", ">", 0.0933866), ("line_length", ">", 64.5667), ("clusters_word", ">", 0.113889)]),
        ("junk", [("marks_token", ">", 0.287295), ("digits", "<=", 0.0292049), ("closed", ">", 0.0294118), ("same_lines", "<=", 0.966667)]),
        ("junk", [("common_word", "<=", 0.157355), ("word_length", "<=", 2.36271), ("letters", "<=", 0.453367), ("token_length", ">", 5.94868), ("word_length", "<=", 2.01667)]),
        ("junk", [("common_word", "<=", 0.160065), ("same_keys", ">", 0.511905), ("closed", ">", 0.0277778), ("line_length", "<=", 31.1), ("latin_word", "<=", 0.0769231)]),
        ("junk", [("common_word", "<=", 0.158476), ("dots_token", ">", 0.00921679), ("letters", ">", 0.543651), ("variety", "<=", 3.63122), ("inner_word", "<=", 0.0277778)]),
        ("junk", [("digits", ">", 0.314958), ("line_length", ">", 46.3333)]),
        ("junk", [("same_keys", ">", 0.672619), ("calls_word", ">", 0.0470653), ("keyed", "<=", 0.0575658), ("digits", "<=", 0.0660273)]),
        ("junk", [("variety", "<=", 0.817445), ("words", "<=", 267.0), ("variety", "<=", 0.611183)]),
        ("junk", [("marks_token", ">", 0.130397), ("same_keys", ">", 0.519231), ("semicolons_word", ">", 0.00490196), ("lines", ">", 1.5)]),
        ("junk", [("common_word", "<=", 0.159918), ("bangs_word", ">", 0.535714), ("words", ">", 6.5)]),
        ("junk", [("odd_word", ">", 0.0666667)]),
        ("junk", [("ends_char", "<=", 0.018884), ("mixed_word", ">", 0.124749), ("words_line", ">", 8.33333), ("glued_word", "<=", 0.25744)]),
        ("junk", [("ends_char", "<=", 0.018413), ("same_keys", ">", 0.559028), ("assigned", ">", 0.0416667), ("assigned", "<=", 0.9), ("glued_word", ">", 0.0675676)]),
        ("junk", [("words_line", "<=", 2.42991), ("token_length", ">", 6.52361), ("keyed", ">", 0.234375), ("same_parts", ">", 0.838542), ("keyed", "<=", 0.928571)]),
        ("junk", [("common_word", "<=", 0.202456), ("words_line", "<=", 1.7625), ("line_length", ">", 8.10833), ("letters", ">", 0.839339), ("blanks", ">", 0.116413)]),
        ("junk", [("closed", ">", 0.121324), ("digits", "<=", 0.0444705), ("ends_char", "<=", 0.0186932), ("letters", ">", 0.640873), ("glued_word", ">", 0.131884), ("letters", "<=", 0.752483)]),
        ("junk", [("variety", "<=", 0.956433), ("ends_char", ">", 0.00225225), ("numbers_token", "<=", 0.0201342), ("ends_char", "<=", 0.0503763), ("token_length", "<=", 6.78729)]),
        ("junk", [("calls_word", ">", 0.180461), ("calls_word", ">", 0.206731)]),
        ("junk", [("words", "<=", 26.5), ("marks_token", ">", 0.0488095), ("same_keys", ">", 0.55), ("token_length", ">", 7.0372), ("keyed", "<=", 0.928571), ("keyed", ">", 0.733333)]),
        ("junk", [("words", "<=", 30.5), ("marks_token", ">", 0.061553), ("same_cells", ">", 0.366667), ("ends_char", "<=", 0.0121969), ("numbers_token", ">", 0.0185185), ("line_length", ">", 58.75), ("blanks", ">", 0.175378)]),
        ("junk", [("marks_token", ">", 0.249537), ("words", "<=", 15.5), ("closed", ">", 0.1), ("same_keys", ">", 0.375), ("token_length", ">", 5.73214)]),
        ("junk", [("bangs_word", ">", 0.420833), ("variety", ">", 2.54762)]),
        ("junk", [("common_word", "<=", 0.100104), ("vowelless_word", ">", 0.0699714), ("same_keys", ">", 0.416667), ("letters", "<=", 0.667558), ("token_length", ">", 6.20158), ("digits", "<=", 0.0690981)]),
        ("junk", [("variety", "<=", 3.23303), ("quotes_word", ">", 0.174242), ("words_line", "<=", 5.16667), ("blanks", ">", 0.140873), ("ended", "<=", 0.25)]),
        ("junk", [("variety", "<=", 0.923767), ("ends_char", ">", 0.00225225), ("numbers_token", "<=", 0.0201342), ("digits", ">", 0.0115772), ("marks_token", "<=", 0.0538462)]),
        ("junk", [("ends_char", "<=", 0.0253343), ("same_cells", ">", 0.348485), ("pipes", ">", 0.0833333)]),
        ("junk", [("common_word", "<=", 0.100104), ("clusters_word", ">", 0.225), ("vowelless_word", ">", 0.0108696)]),
        ("junk", [("ends_char", "<=", 0.0244234), ("same_cells", ">", 0.292857), ("glued_word", ">", 0.124228), ("blanks", ">", 0.166235), ("calls_word", ">", 0.0142194), ("separators_end", ">", 0.416667)]),
        ("junk", [("variety", "<=", 2.32437), ("glued_word", ">", 0.142582), ("words", "<=", 5.5), ("same_keys", ">", 0.5), ("glued_word", ">", 0.325)]),
        ("junk", [("words", "<=", 19.5), ("marks_token", ">", 0.0754986), ("closed", ">", 0.171429), ("words_line", ">", 7.75), ("token_length", "<=", 6.46875)]),
        ("junk", [("variety", "<=", 2.2686), ("glued_word", ">", 0.142582), ("same_cells", ">", 0.416667), ("token_length", "<=", 6.38182), ("words_line", ">", 3.25), ("ends_char", "<=", 0.0378571), ("marks_token", ">", 0.295699), ("words", "<=", 6.0)]),
        ("junk", [("common_word", "<=", 0.0205489), ("marks_token", ">", 0.141604), ("same_keys", ">", 0.694444), ("keyed", "<=", 0.0208333), ("assigned", "<=", 0.125), ("word_length", ">", 4.38333)]),
        ("junk", [("latin_word", ">", 0.516667), ("ended", "<=", 0.5)]),
        ("junk", [("variety", "<=", 1.26065), ("line_length", ">", 41.275), ("common_word", ">", 0.183658), ("separators_end", "<=", 0.868452), ("ended", "<=", 0.7), ("numbered", "<=", 0.5)]),
        ("junk", [("common_word", "<=", 0.0204781), ("indents", ">", 0.277778), ("words_line", "<=", 2.5), ("bullets", "<=", 0.583333), ("signs", "<=", 0.416667)]),
        ("junk", [("common_word", "<=", 0.129171), ("marks_token", ">", 0.0767594), ("words", "<=", 16.5), ("calls_word", ">", 0.03125), ("separators_end", ">", 0.416667)]),
        ("junk", [("common_word", "<=", 0.200418), ("words", "<=", 19.5), ("marks_token", ">", 0.0889328), ("closed", ">", 0.225), ("line_length", "<=", 13.4167), ("ended", "<=", 0.833333)]),
        ("junk", [("words", "<=", 19.5), ("marks_token", ">", 0.0754986), ("common_word", "<=", 0.129167), ("closed", ">", 0.944444), ("quotes_word", ">", 0.0769231)]),
        ("junk", [("common_word", "<=", 0.133568), ("glued_word", ">", 0.190066), ("same_cells", ">", 0.240385), ("token_length", "<=", 5.40833), ("commas_word", ">", 0.0142857), ("word_length", ">", 2.84785)]),
        ("table", [("letters", "<=", 0.599288), ("ends_char", "<=", 0.00561181), ("line_length", ">", 24.0323), ("variety", ">", 3.0925), ("lines", ">", 5.5)]),
        ("table", [("ends_char", "<=", 0.00275951), ("numbers_token", ">", 0.00833333), ("glued_word", ">", 0.020375), ("letters", "<=", 0.712705), ("same_cells", "<=", 0.225), ("marks_token", ">", 0.0636609)]),
        ("table", [("marks_token", ">", 1.2775), ("closed", ">", 0.00819672), ("glued_word", "<=", 0.459677)]),
        ("table", [("ends_char", "<=", 0.000943396), ("numbers_token", ">", 0.0408333), ("marks_token", ">", 0.00574713), ("blanks", ">", 0.144728), ("marks_token", ">", 0.19246), ("same_cells", "<=", 0.75)]),
        ("table", [("numbers_token", ">", 0.115663), ("ends_char", "<=", 0.000948767), ("same_cells", "<=", 0.416667), ("keyed", ">", 0.583333)]),
        ("table", [("tight_token", ">", 0.327273)]),
        ("table", [("tabs", ">", 1.0)]),
        ("table", [("blanks", ">", 0.442414), ("bullets", "<=", 0.3)]),
        ("table", [("assigned", ">", 0.25), ("same_cells", "<=", 0.55), ("ended", "<=", 0.261905)]),
        ("table", [("keyed", ">", 0.65), ("words_line", "<=", 4.42262), ("letters", ">", 0.715484), ("numbers_token", ">", 0.0232558)]),
        ("table", [("pipes", ">", 1.10714)]),
        ("table", [("ends_char", "<=", 0.000943396), ("numbers_token", ">", 0.0238636), ("keyed", ">", 0.291667), ("glued_word", ">", 0.00462963)]),
        ("table", [("inner_word", ">", 0.919137), ("numbers_token", ">", 0.0344828), ("numbered", "<=", 0.333333)]),
        ("list", [("ended", "<=", 0.0527778), ("same_cells", "<=", 0.211111), ("words_line", "<=", 3.62132), ("numbers_token", "<=", 0.0208333), ("token_length", "<=", 7.44116)]),
        ("list", [("ended", "<=", 0.0178571), ("glued_word", ">", 0.0200167), ("separators_end", ">", 0.788889), ("line_length", ">", 65.5), ("blanks", "<=", 0.186974)]),
        ("list", [("ended", "<=", 0.0178571), ("same_cells", "<=", 0.354167), ("glued_word", ">", 0.170112), ("marks_token", ">", 0.32905), ("vowelless_word", ">", 0.0458416)]),
        ("list", [("ended", "<=", 0.0178571), ("slashes_word", ">", 0.00140449), ("signs", "<=", 0.25), ("gaps", "<=", 0.25)]),
        ("list", [("ended", "<=", 0.0188679), ("same_cells", "<=", 0.55), ("words_line", "<=", 3.97917), ("marks_token", ">", 0.0217517), ("bullets", ">", 0.45)]),
        ("list", [("ended", "<=", 0.0178571), ("same_cells", "<=", 0.354167), ("words_line", "<=", 3.65833), ("numbered", ">", 0.5)]),
        ("list", [("bullets", ">", 0.45), ("lines", ">", 2.5), ("gaps", "<=", 0.5)]),
        ("list", [("ended", "<=", 0.0178571), ("keyed", ">", 0.025), ("variety", ">", 2.68346), ("glued_word", ">", 0.0871212)]),
        ("list", [("ended", "<=", 0.0178571), ("separators_end", ">", 3.5), ("commas_word", ">", 0.0944919)]),
        ("list", [("numbered", ">", 0.55), ("lines", ">", 1.5)]),
        ("list", [("ended", "<=", 0.0178571), ("semicolons_word", ">", 0.100362), ("quotes_word", "<=", 0.2)]),
        ("list", [("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.583333), ("words_line", "<=", 2.78125), ("numbers_token", "<=", 0.0238095), ("common_word", ">", 0.0192308), ("glued_word", "<=", 0.536325), ("ended", "<=", 0.25)]),
        ("list", [("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.583333), ("numbers_token", "<=", 0.0113636), ("words_line", "<=", 3.62132), ("words", ">", 23.5)]),
        ("list", [("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.583333), ("numbers_token", "<=", 0.0125), ("word_length", ">", 4.0963), ("digits", ">", 0.00255428), ("variety", "<=", 3.25181)]),
        ("list", [("ends_char", "<=", 0.00094518), ("same_cells", "<=", 0.583333), ("numbers_token", "<=", 0.0113636), ("words_line", "<=", 3.6125), ("bullets", ">", 0.45)]),
        ("list", [("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.583333), ("numbers_token", "<=", 0.0113636), ("words_line", "<=", 4.58125), ("keyed", ">", 0.0625), ("same_keys", ">", 0.833333)]),
        ("list", [("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.583333), ("numbers_token", "<=", 0.0113636), ("variety", ">", 2.22483), ("same_cells", "<=", 0.211111), ("digits", "<=", 0.0351504), ("inner_word", ">", 0.00537634)]),
        ("list", [("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.583333), ("vowelless_word", ">", 0.121324), ("blanks", "<=", 0.124612)]),
        ("list", [("bullets", ">", 0.240385), ("marks_token", "<=", 0.156469), ("bullets", ">", 0.45), ("words", ">", 7.0)]),
        ("list", [("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.583333), ("line_length", "<=", 20.5833), ("numbers_token", "<=", 0.0217391), ("line_length", "<=", 8.5625), ("same_parts", ">", 0.733333)]),
        ("list", [("ends_char", "<=", 0.00094518), ("same_cells", "<=", 0.583333), ("line_length", "<=", 21.0625), ("common_word", ">", 0.253205), ("same_cells", "<=", 0.225)]),
        ("list", [("ends_char", "<=", 0.00094518), ("same_cells", "<=", 0.583333), ("numbers_token", "<=", 0.0113636), ("words_line", "<=", 3.41667), ("marks_token", ">", 0.0333333), ("letters", ">", 0.799499)]),
    ],
    [
        ("junk", [("marks_token", ">", 0.292568), ("quotes_word", ">", 0.00243902), ("same_keys", ">", 0.51), ("variety", "<=", 4.66403), ("numbers_token", "<=", 0.171429)]),
        ("junk", [("common_word", "<=", 0.157355), ("vowelless_word", ">", 0.0933866), ("line_length", ">", 70.2315), ("clusters_word", ">", 0.0517241)]),
        ("junk", [("marks_token", ">", 0.292568), ("digits", "<=", 0.0292049), ("letters", "<=", 0.65183), ("ends_char", ">", 0.000413223), ("words_line", "<=", 5.95), ("bullets", "<=", 0.5)]),
        ("junk", [("common_word", "<=", 0.158462), ("mixed_word", ">", 0.0858259), ("inner_word", ">", 0.00416667), ("token_length", ">", 7.83389)]),
        ("junk", [("common_word", "<=", 0.164892), ("dots_token", ">", 0.00587222), ("letters", ">", 0.542189), ("variety", "<=", 3.63733), ("digits", "<=", 0.0350985)]),
        ("junk", [("variety", "<=", 0.764947), ("words", "<=", 312.5), ("variety", "<=", 0.627389)]),
        ("junk", [("same_keys", ">", 0.511905), ("calls_word", ">", 0.0325225), ("keyed", "<=", 0.0550595), ("clusters_word", "<=", 0.0149917)]),
        ("junk", [("marks_token", ">", 0.272166), ("ended", ">", 0.0220856), ("digits", "<=", 0.0774612), ("letters", "<=", 0.663188), ("glued_word", "<=", 0.0839202), ("marks_token", ">", 0.357676)]),
        ("junk", [("ends_char", "<=", 0.0184413), ("digits", ">", 0.331602)]),
        ("junk", [("common_word", "<=", 0.164921), ("same_keys", ">", 0.519231), ("assigned", ">", 0.0416667), ("assigned", "<=", 0.9), ("glued_word", ">", 0.0588235)]),
        ("junk", [("common_word", "<=", 0.158675), ("mixed_word", ">", 0.133038), ("indents", ">", 0.166667), ("word_length", ">", 2.79326)]),
        ("junk", [("common_word", "<=", 0.126102), ("same_keys", ">", 0.559028), ("vowelless_word", ">", 0.0712473), ("keyed", "<=", 0.928571), ("token_length", ">", 7.84524), ("glued_word", "<=", 0.266798)]),
        ("junk", [("common_word", "<=", 0.109001), ("words_line", "<=", 1.97434), ("line_length", ">", 8.08889), ("letters", ">", 0.843657), ("blanks", ">", 0.122564)]),
        ("junk", [("latin_word", ">", 0.425352), ("bangs_word", "<=", 0.146739)]),
        ("junk", [("closed", ">", 0.0826503), ("digits", "<=", 0.0400617), ("ends_char", "<=", 0.0219807), ("glued_word", ">", 0.120606), ("marks_token", "<=", 0.383634), ("variety", "<=", 4.73719)]),
        ("junk", [("marks_token", ">", 0.272308), ("digits", "<=", 0.0538692), ("closed", ">", 0.0768116), ("digits", "<=", 0.010009), ("ended", "<=", 0.956522), ("letters", "<=", 0.756239), ("cells_char", "<=", 0.0261097)]),
        ("junk", [("same_keys", ">", 0.604348), ("words_line", "<=", 3.6125), ("keyed", ">", 0.3875), ("token_length", ">", 6.68333), ("lines", ">", 5.5)]),
        ("junk", [("marks_token", ">", 0.288068), ("words", "<=", 12.5), ("calls_word", ">", 0.0954545), ("calls_word", ">", 0.190909)]),
        ("junk", [("glued_word", ">", 0.140269), ("same_cells", ">", 0.212406), ("dots_token", ">", 0.0215079), ("pipes", "<=", 1.13889)]),
        ("junk", [("bangs_word", ">", 0.541667), ("words", ">", 5.5)]),
        ("junk", [("ends_char", "<=", 0.021486), ("semicolons_word", ">", 0.017456), ("glued_word", ">", 0.117072)]),
        ("junk", [("variety", "<=", 0.936804), ("common_word", ">", 0.19976), ("words_line", ">", 4.67812), ("same_parts", "<=", 0.45), ("semicolons_word", "<=", 0.229107)]),
        ("junk", [("ends_char", "<=", 0.0220704), ("same_cells", ">", 0.19375), ("glued_word", ">", 0.121917), ("calls_word", ">", 0.00555556), ("separators_end", ">", 0.633333), ("closed", "<=", 0.875)]),
        ("junk", [("same_keys", ">", 0.563492), ("marks_token", ">", 0.4274), ("keyed", "<=", 0.00406504), ("words_line", "<=", 4.41667), ("assigned", "<=", 0.8), ("letters", ">", 0.58364)]),
        ("junk", [("common_word", "<=", 0.171261), ("same_keys", ">", 0.483333), ("indents", ">", 0.158824), ("words_line", "<=", 2.57778), ("blanks", "<=", 0.282142)]),
        ("junk", [("closed", ">", 0.0871212), ("words", "<=", 20.5), ("same_keys", ">", 0.25), ("token_length", ">", 6.16234)]),
        ("junk", [("common_word", "<=", 0.250088), ("same_cells", ">", 0.36039), ("pipes", ">", 0.0454545)]),
        ("junk", [("same_lines", "<=", 0.365152), ("letters", ">", 0.842826), ("line_length", ">", 8.49138), ("words_line", "<=", 1.68333), ("words_line", ">", 1.03125)]),
        ("junk", [("variety", "<=", 1.28122), ("ends_char", ">", 0.00409701), ("blanks", ">", 0.163914), ("words", "<=", 204.0), ("same_parts", "<=", 0.1375), ("semicolons_word", "<=", 0.191176)]),
        ("junk", [("glued_word", ">", 0.0908109), ("same_cells", ">", 0.269697), ("token_length", "<=", 5.25735), ("ends_char", "<=", 0.020101), ("same_cells", ">", 0.583333), ("numbers_token", ">", 0.0192308), ("common_word", "<=", 0.306667)]),
        ("junk", [("variety", "<=", 0.922971), ("words", "<=", 80.0), ("words", ">", 18.5), ("letters", "<=", 0.830077)]),
        ("junk", [("marks_token", ">", 0.326478), ("mixed_word", ">", 0.179144), ("blanks", ">", 0.153529), ("line_length", ">", 45.0)]),
        ("junk", [("glued_word", ">", 0.199585), ("same_cells", ">", 0.261364), ("token_length", "<=", 6.0303), ("signs", ">", 0.1), ("letters", "<=", 0.552778), ("glued_word", "<=", 0.633333)]),
        ("junk", [("ends_char", "<=", 0.0230838), ("same_cells", ">", 0.236111), ("glued_word", ">", 0.0999655), ("token_length", "<=", 5.45804), ("ended", ">", 0.0625), ("closed", ">", 0.0625)]),
        ("junk", [("clusters_word", ">", 0.2158), ("vowelless_word", ">", 0.0192029), ("common_word", "<=", 0.126812)]),
        ("junk", [("marks_token", ">", 0.0768213), ("words", "<=", 13.5), ("line_length", "<=", 23.875), ("words_line", ">", 3.83333), ("glued_word", ">", 0.226496), ("glued_word", "<=", 0.267857), ("common_word", "<=", 0.100962)]),
        ("junk", [("marks_token", ">", 0.0831413), ("digits", "<=", 0.0714667), ("token_length", "<=", 5.43019), ("numbers_token", ">", 0.13985), ("ended", "<=", 0.5), ("closed", "<=", 0.4)]),
        ("junk", [("marks_token", ">", 0.272308), ("same_keys", ">", 0.458333), ("closed", ">", 0.0864382), ("digits", "<=", 0.0565283), ("common_word", "<=", 0.101147)]),
        ("junk", [("assigned", ">", 0.0833333), ("assigned", "<=", 0.583333), ("inner_word", "<=", 0.489925)]),
        ("junk", [("variety", "<=", 3.70871), ("line_length", ">", 57.6583), ("variety", "<=", 1.50378), ("common_word", ">", 0.214608), ("separators_end", "<=", 0.704891), ("ended", "<=", 0.5)]),
        ("table", [("letters", "<=", 0.588969), ("ends_char", "<=", 0.00420532), ("line_length", ">", 24.0323), ("variety", ">", 3.17704), ("lines", ">", 5.5)]),
        ("table", [("ends_char", "<=", 0.00375595), ("numbers_token", ">", 0.00833333), ("marks_token", ">", 0.00694444), ("letters", "<=", 0.737798), ("words_line", "<=", 3.81667), ("glued_word", "<=", 0.152029)]),
        ("table", [("ends_char", "<=", 0.00465126), ("digits", ">", 0.040151), ("line_length", ">", 41.5278), ("letters", "<=", 0.617314), ("token_length", ">", 9.50794), ("separators_end", "<=", 78.5)]),
        ("table", [("ends_char", "<=", 0.00593477), ("numbers_token", ">", 0.00847458), ("marks_token", ">", 0.114835), ("blanks", ">", 0.153962), ("indents", "<=", 0.633333)]),
        ("table", [("tight_token", ">", 0.317391)]),
        ("table", [("numbers_token", ">", 0.102418), ("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.416667), ("letters", "<=", 0.760135), ("word_length", ">", 4.20526), ("same_keys", "<=", 0.75)]),
        ("table", [("ends_char", "<=", 0.00094518), ("numbers_token", ">", 0.0439614), ("glued_word", ">", 0.00393701), ("keyed", ">", 0.0294118), ("bullets", "<=", 0.25)]),
        ("table", [("ends_char", "<=", 0.000948767), ("numbers_token", ">", 0.0598013), ("marks_token", ">", 0.176931), ("variety", ">", 3.21777), ("letters", "<=", 0.709955)]),
        ("table", [("ends_char", "<=", 0.000943396), ("numbers_token", ">", 0.0598013), ("same_cells", "<=", 0.416667), ("letters", "<=", 0.723406), ("numbers_token", ">", 0.232406), ("same_parts", ">", 0.732143)]),
        ("table", [("ends_char", "<=", 0.00094518), ("numbers_token", ">", 0.0245215), ("same_keys", ">", 0.154762), ("same_keys", "<=", 0.55), ("words_line", "<=", 5.45)]),
        ("table", [("assigned", ">", 0.166667)]),
        ("table", [("marks_token", ">", 1.2087), ("letters", "<=", 0.636838), ("line_length", ">", 47.5952), ("ended", "<=", 0.5)]),
        ("table", [("tabs", ">", 1.0)]),
        ("table", [("inner_word", ">", 0.156645), ("numbers_token", ">", 0.0555556), ("numbered", "<=", 0.333333)]),
        ("table", [("closed", ">", 0.732143), ("ended", "<=", 0.25), ("variety", ">", 3.01122)]),
        ("table", [("blanks", ">", 0.526675)]),
        ("table", [("pipes", ">", 0.888889), ("pipes", "<=", 4.5)]),
        ("list", [("ended", "<=", 0.0527778), ("same_cells", "<=", 0.225), ("words_line", "<=", 3.61875), ("numbers_token", "<=", 0.0227273), ("marks_token", ">", 0.004)]),
        ("list", [("ended", "<=", 0.0188679), ("glued_word", ">", 0.016201), ("separators_end", ">", 0.775), ("line_length", ">", 65.5), ("numbers_token", "<=", 0.030303)]),
        ("list", [("ended", "<=", 0.0417391), ("same_cells", "<=", 0.267857), ("numbers_token", "<=", 0.00649351), ("words_line", "<=", 3.62132)]),
        ("list", [("ended", "<=", 0.0178571), ("same_keys", ">", 0.003125), ("glued_word", ">", 0.191729), ("same_cells", "<=", 0.183333)]),
        ("list", [("ended", "<=", 0.0178571), ("slashes_word", ">", 0.00140449), ("signs", "<=", 0.25)]),
        ("list", [("bullets", ">", 0.45), ("lines", ">", 2.5), ("bullets", ">", 0.525)]),
        ("list", [("ended", "<=", 0.0178571), ("numbered", ">", 0.65), ("same_cells", "<=", 0.75)]),
        ("list", [("ended", "<=", 0.0178571), ("marks_token", ">", 0.205263), ("signs", "<=", 0.125), ("separators_end", ">", 0.733333), ("commas_word", "<=", 0.00314465)]),
        ("list", [("ends_char", "<=", 0.000943396), ("separators_end", ">", 3.5), ("commas_word", ">", 0.134074)]),
        ("list", [("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.583333), ("glued_word", ">", 0.246951), ("blanks", "<=", 0.116859)]),
        ("list", [("numbered", ">", 0.5625), ("lines", ">", 1.5)]),
        ("list", [("bullets", ">", 0.45), ("ends_char", "<=", 0.00641026), ("vowelless_word", "<=", 0.0888889), ("same_cells", "<=", 0.75)]),
        ("list", [("ends_char", "<=", 0.00101833), ("same_cells", "<=", 0.583333), ("numbers_token", "<=", 0.0113636), ("words_line", "<=", 3.41667), ("common_word", ">", 0.0144928), ("same_cells", "<=", 0.416667)]),
        ("list", [("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.583333), ("numbers_token", "<=", 0.0131579), ("token_length", "<=", 7.775), ("keyed", ">", 0.0625), ("same_keys", ">", 0.583333)]),
        ("list", [("ends_char", "<=", 0.00094518), ("same_cells", "<=", 0.583333), ("numbers_token", "<=", 0.0113636), ("words_line", "<=", 4.58125), ("common_word", ">", 0.232051), ("words", ">", 17.5)]),
        ("list", [("ends_char", "<=", 0.000943396), ("same_cells", "<=", 0.583333), ("words_line", "<=", 2.58333), ("numbers_token", "<=", 0.0277778), ("token_length", "<=", 6.55), ("token_length", ">", 3.9), ("line_length", "<=", 14.0)]),
    ],
]
