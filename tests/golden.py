"""Golden data: the analysed pipeline's published hold-out predictions of its
best model (code, probability, outcome; 223 rows) and the risk table and
metrics it derived from them.  Fixed values, kept verbatim."""

# (DRG01, Predicted_Flip_Prob, Actual_Flipped)
PREDICTIONS = [
    (780, 0.3318496815188776, 0),
    (786, 0.5477160313124979, 0),
    (786, 0.3303376338992468, 0),
    (486, 0.518268071944073, 0),
    (789, 0.34884992130152126, 0),
    (276, 0.5039768447619238, 1),
    (780, 0.4508841005456389, 0),
    (786, 0.41354772758292574, 0),
    (780, 0.475617889383835, 1),
    (787, 0.3782055903552437, 0),
    (780, 0.48213070945597314, 1),
    (782, 0.4972092867455931, 1),
    (789, 0.4168028468792345, 0),
    (780, 0.4506542149813514, 0),
    (786, 0.26940719013659786, 0),
    (787, 0.5485010918035342, 1),
    (787, 0.5748032639870518, 0),
    (558, 0.8059668796379187, 1),
    (276, 0.49886682578808783, 1),
    (780, 0.5195122910350208, 0),
    (780, 0.32805123017890053, 1),
    (787, 0.4214018159242184, 1),
    (276, 0.5845747981691788, 1),
    (787, 0.5482765763051718, 1),
    (428, 0.5874492584866173, 1),
    (780, 0.45556047043122017, 0),
    (428, 0.5518767781363778, 0),
    (786, 0.4103178295576281, 1),
    (786, 0.4037332472756836, 0),
    (276, 0.5835034850836406, 1),
    (558, 0.721316614491267, 0),
    (780, 0.3421203452383268, 1),
    (787, 0.47293819435305656, 1),
    (780, 0.3848097709831114, 1),
    (780, 0.4930856916560036, 1),
    (780, 0.46181431742971557, 1),
    (789, 0.24282597293492725, 0),
    (782, 0.4006267047172915, 1),
    (780, 0.38814400100737356, 0),
    (780, 0.5470269002604746, 0),
    (599, 0.6608557358383846, 1),
    (786, 0.44992354815444474, 1),
    (786, 0.3589874051422898, 0),
    (599, 0.5268958891450299, 0),
    (780, 0.39730013008703324, 0),
    (789, 0.574195380099103, 0),
    (276, 0.5496876448214251, 0),
    (787, 0.5253434256916496, 0),
    (780, 0.42836389795720314, 0),
    (428, 0.6470044367304721, 0),
    (780, 0.43501585106059715, 0),
    (276, 0.5309334838726696, 1),
    (780, 0.3908572819827687, 0),
    (486, 0.4976056173447487, 0),
    (578, 0.5815142445589122, 1),
    (599, 0.550642049169355, 1),
    (599, 0.6051960802244339, 0),
    (599, 0.6679304552123255, 1),
    (780, 0.4959869122388589, 1),
    (599, 0.571941138166039, 1),
    (780, 0.44778970726963263, 0),
    (276, 0.5669236813372985, 0),
    (428, 0.6121363600451134, 0),
    (789, 0.3929656575815868, 0),
    (578, 0.5689580085212744, 1),
    (558, 0.649106844197375, 0),
    (577, 0.4837583593726247, 1),
    (780, 0.38643287129165543, 1),
    (787, 0.5662586815081447, 1),
    (276, 0.5521444395711294, 0),
    (789, 0.32377201643583464, 0),
    (789, 0.2517174413956002, 0),
    (599, 0.6341720862287054, 0),
    (599, 0.5729871512637148, 1),
    (789, 0.331116869438319, 1),
    (786, 0.3598666319034919, 1),
    (780, 0.36805399814587497, 1),
    (789, 0.5942738372456755, 1),
    (780, 0.4212381996268877, 0),
    (780, 0.4133952097778272, 0),
    (787, 0.5253080842723896, 0),
    (780, 0.5329718426840312, 1),
    (780, 0.5156710789506654, 0),
    (789, 0.4761197663103776, 0),
    (780, 0.45864699291514444, 0),
    (276, 0.5400869885500375, 1),
    (780, 0.5423415495131909, 0),
    (789, 0.31883108296519475, 1),
    (789, 0.4144916983488192, 1),
    (786, 0.28706103038510294, 0),
    (787, 0.4932037898714025, 0),
    (780, 0.3588281396064029, 0),
    (276, 0.5851701045017217, 0),
    (599, 0.5421889047411096, 1),
    (599, 0.5642638983227429, 1),
    (276, 0.5569741726556573, 1),
    (786, 0.45023279041043474, 1),
    (486, 0.569064348101271, 1),
    (786, 0.44456986465227644, 0),
    (428, 0.6141600550770986, 0),
    (786, 0.6247916183180839, 1),
    (780, 0.41004741970677516, 0),
    (276, 0.5457717320397508, 0),
    (786, 0.41412383860432217, 0),
    (577, 0.5476156446269776, 1),
    (578, 0.5832955358017081, 0),
    (780, 0.41113383553053273, 0),
    (786, 0.40034903368448943, 1),
    (789, 0.33401253030035855, 1),
    (276, 0.5399253223509569, 0),
    (578, 0.5789505752833414, 1),
    (486, 0.5952713827091861, 1),
    (780, 0.4200398958489556, 0),
    (276, 0.6173251719119905, 1),
    (577, 0.6450492103426011, 1),
    (780, 0.6097997923682316, 0),
    (786, 0.37890834844974636, 0),
    (786, 0.49194407564205006, 1),
    (486, 0.6085991834245701, 0),
    (276, 0.5431582797530634, 1),
    (276, 0.5027988144239675, 1),
    (599, 0.67695082435076, 1),
    (782, 0.4859749449504958, 1),
    (486, 0.5438771390016093, 0),
    (780, 0.4134977784671474, 0),
    (787, 0.4646573730650466, 1),
    (787, 0.5757260465021017, 1),
    (780, 0.46165472073192915, 0),
    (789, 0.34133217554115997, 0),
    (276, 0.5392013955391377, 0),
    (780, 0.5373443881035666, 1),
    (786, 0.4522663182501732, 0),
    (789, 0.4554961406392601, 0),
    (780, 0.45433581213355806, 0),
    (789, 0.5169293130122166, 0),
    (789, 0.3679137156410175, 0),
    (786, 0.48728275894822437, 0),
    (786, 0.5942532631952195, 1),
    (558, 0.5377885122481708, 1),
    (276, 0.3725701919521669, 1),
    (780, 0.4522832498982603, 1),
    (599, 0.6760065478243763, 0),
    (789, 0.36124822371983667, 0),
    (786, 0.4523969491887864, 0),
    (780, 0.4931754605506217, 1),
    (558, 0.5893424544883857, 0),
    (789, 0.4764691105484073, 1),
    (789, 0.3398919011458911, 0),
    (578, 0.5212614513917287, 0),
    (276, 0.4957246018770888, 0),
    (780, 0.48917055654745256, 0),
    (780, 0.4807600309362649, 1),
    (780, 0.31438211670816874, 0),
    (577, 0.7035153528308884, 0),
    (599, 0.6110002768223055, 1),
    (789, 0.37945128023175634, 0),
    (786, 0.5132736631485135, 1),
    (276, 0.5728930827479932, 1),
    (780, 0.3420487101629506, 0),
    (786, 0.3167276715904638, 0),
    (558, 0.6772002579832623, 0),
    (789, 0.2666819773852688, 0),
    (780, 0.390098617605117, 0),
    (578, 0.5486059239361785, 0),
    (786, 0.30503916570444056, 0),
    (780, 0.3887684486664472, 1),
    (599, 0.6076399155817835, 1),
    (789, 0.41266751067606927, 1),
    (780, 0.4679299195072846, 0),
    (599, 0.6968122299034133, 1),
    (789, 0.44840487443429944, 1),
    (276, 0.6141054319190556, 1),
    (786, 0.3782566570908938, 0),
    (789, 0.5024185925330047, 0),
    (276, 0.6337496687515738, 1),
    (276, 0.44487912532576446, 0),
    (782, 0.41959882447729924, 0),
    (780, 0.4926585431840628, 0),
    (578, 0.43422084871802097, 0),
    (276, 0.496594797122915, 1),
    (428, 0.629629092519394, 1),
    (486, 0.5436142033693668, 1),
    (780, 0.4908242803696132, 0),
    (787, 0.48339572341825454, 0),
    (276, 0.5541409726124743, 1),
    (786, 0.43055351460038743, 1),
    (786, 0.39405723293142686, 1),
    (787, 0.5192963638635534, 0),
    (780, 0.3824362722415403, 0),
    (780, 0.5061175497952359, 0),
    (789, 0.4313161489409248, 1),
    (780, 0.3985219855995033, 1),
    (780, 0.46320836461334375, 1),
    (276, 0.5209035487866222, 0),
    (787, 0.48677422361184214, 0),
    (786, 0.6206230550085062, 1),
    (486, 0.6244204033544407, 1),
    (789, 0.6127361913575378, 1),
    (786, 0.3424509832664949, 1),
    (276, 0.6034299786874116, 1),
    (599, 0.6967518243802285, 0),
    (787, 0.5875858210823512, 1),
    (780, 0.5350843653141497, 1),
    (780, 0.3351557867335038, 0),
    (786, 0.5163141385408722, 1),
    (780, 0.3908920200435679, 0),
    (780, 0.4481024862883645, 1),
    (780, 0.4654189730378608, 1),
    (786, 0.2676012106962966, 0),
    (780, 0.5280055915441623, 1),
    (787, 0.3412504217883231, 1),
    (486, 0.6441619467031957, 1),
    (787, 0.4197705317612605, 0),
    (780, 0.6031143553398292, 0),
    (780, 0.48720843119648355, 1),
    (789, 0.4490851477805351, 0),
    (780, 0.5348851572412523, 0),
    (786, 0.24357743633594012, 0),
    (599, 0.6866219492592941, 0),
    (786, 0.5958379148112449, 0),
    (276, 0.5587044746791805, 0),
    (786, 0.39332472835923193, 0),
    (780, 0.5234527433228482, 1),
]

# (DRG01, Avg_Prob, Actual_Rate, Count, DiagnosisName, Avg_Prob_Pct, Actual_Pct, Risk_Tier)
RISK = [
    (789, 0.4065006187437049, 0.35714285714285715, 28, 'Abdominal Pain', 40.7, 35.7, 'Medium Risk (35–55%)'),
    (786, 0.4217545443170126, 0.4117647058823529, 34, 'Chest Pain', 42.2, 41.2, 'Medium Risk (35–55%)'),
    (780, 0.44880182155729326, 0.3870967741935484, 62, 'Syncope', 44.9, 38.7, 'Medium Risk (35–55%)'),
    (782, 0.4508524402226699, 0.75, 4, 'Edema', 45.1, 75.0, 'Medium Risk (35–55%)'),
    (787, 0.49626094550914424, 0.5, 18, 'Nausea', 49.6, 50.0, 'Medium Risk (35–55%)'),
    (276, 0.5431685378426387, 0.6071428571428571, 28, 'Dehydration', 54.3, 60.7, 'Medium Risk (35–55%)'),
    (578, 0.5452580840301663, 0.42857142857142855, 7, 'GI Bleeding', 54.5, 42.9, 'Medium Risk (35–55%)'),
    (486, 0.5716535884391624, 0.5555555555555556, 9, 'Pneumonia', 57.2, 55.6, 'High Risk (>55%)'),
    (577, 0.5949846417932729, 0.75, 4, 'Pancreatitis', 59.5, 75.0, 'High Risk (>55%)'),
    (428, 0.6070426634991789, 0.3333333333333333, 6, 'Congestive Heart Failure', 60.7, 33.3, 'High Risk (>55%)'),
    (599, 0.6205209974372942, 0.6470588235294118, 17, 'Urinary Tract Infection', 62.1, 64.7, 'High Risk (>55%)'),
    (558, 0.6634535938410633, 0.3333333333333333, 6, 'Colitis', 66.3, 33.3, 'High Risk (>55%)'),
]

# Published metrics of that model (3 decimals; threshold 2).
METRICS = {"roc_auc": 0.623, "precision": 0.484, "recall": 1.000, "f1": 0.652,
           "accuracy": 0.507, "threshold": 0.32}
